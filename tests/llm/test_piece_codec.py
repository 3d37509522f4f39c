import sys

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.piece_codec import MARK, NORMAL, coding_report, decode_ids, encode_texts, pieces

FILE = "piece_bpe_32k.model"
BITS = ["the", " ", "  ", "world", "é", "中", "🤖", "\n", "Hello", ".", "ing", "tion", "123", MARK, "xqz"]


def best_score(text):
    """Highest summed score over all segmentations, by plain dynamic programming."""
    model = pieces(FILE)
    score = {n: s for n, s, k in zip(model.names, model.scores, model.kinds) if k == NORMAL}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + model.worst
        for start in range(max(0, end - 16), end):
            if text[start:end] in score:
                best[end] = max(best[end], best[start] + score[text[start:end]])
    return best[-1]


def test_model_file_is_read_as_the_library_reads_it():
    model, library = pieces(FILE), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(FILE))
    n = library.get_piece_size()
    assert model.names == [library.id_to_piece(i) for i in range(n)]
    assert model.scores == [library.get_score(i) for i in range(n)]
    assert [library.is_byte(i) for i in range(n)] == [k == 6 for k in model.kinds]
    assert max(map(len, model.names)) <= 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(BITS) | st.text(max_size=3), max_size=14))
def test_best_score_and_round_trip(parts):
    text = "".join(parts)
    model = pieces(FILE)
    ids = list(memoryview(model.encode(text)).cast("I"))
    marked = MARK + text.replace(" ", MARK) if text else ""
    total, run = 0.0, b""
    for i in [*ids, None]:
        if i in model.values:
            run += model.values[i]
            continue
        total += model.worst * len(run.decode())
        run = b""
        total += model.scores[i] if i is not None else 0
    assert abs(total - best_score(marked)) <= 1e-6 * max(1, abs(total))
    assert model.decode(ids) == text.replace(MARK, " ")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(FILE))
    assert library.decode(ids) == model.decode(ids)


def test_a_word_is_segmented_without_a_call_for_each_piece():
    model, calls = pieces(FILE), []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        ids = model.segment(MARK + "interestingly中🤖q")
    finally:
        sys.setprofile(None)
    assert calls == ["segment"]
    assert model.decode(ids) == "interestingly中🤖q"


def test_table(docs_of):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "no number"), (1, "Hello world"), (4, "long words " * 20_000), (5, " lead\n🤖")]
    docs = docs_of(rows, ["1 as ids", "2 as score"])
    coded = encode_texts(docs, FILE)
    assert sorted(map(str, decode_ids(coded, FILE).collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    report = coding_report(docs, FILE).collect()
    assert len(report) == 7 and all(r.round_trip for r in report)
    assert {r.n_pieces for r in report if r.doc_id in (2, 3)} == {0}
    assert coding_report(docs_of([]), FILE).count() == 0
