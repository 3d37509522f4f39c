from tickloom.llm.memory import ENTRY, Memory


def test_what_is_used_again_stays_within_two_generations():
    memory = Memory(10 * ENTRY, {"": b""})
    for i in range(300):
        memory.turn()
        keys = {"often", f"once{i}"}
        memory.add({k: k.encode() for k in memory.missing(keys)})
        assert all(memory.now[k] == k.encode() for k in keys) and memory.now[""] == b""
        assert len(memory.now) + len(memory.former) < 30
        assert i == 0 or "often" not in memory.missing({"often"})
