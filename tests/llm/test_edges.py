"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator and stage."""

import pytest

import corpus_pipeline
from shapelake.llm import bpe, chat, exact_dedup, language, mixing, near_dedup, pii, quality, substring_dedup, token_store

#: Columns with names that the operators use inside.
EXTRA = ", n_words long, digest string, bucket string, source_size long, k string, row string, spans string, slice string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
LONG = "wörd " * 30_000 + "x" * 50_000 + " " + "1" * 30_000
FILLER = (None,) * 8


def docs(spark, rows):
    return spark.createDataFrame([(*r, *FILLER) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "one", "en", None, 3), (None, "one", "de", "b", 3),
        (5, LONG, "de", "b", len(LONG)), (6, LONG, "de", "b", len(LONG)), (7, "one two three four five six", "en", "a", 27), (7, "one two three four five six", "en", "a", 27),
        (8, "\U0001f642é́ 日本 <|endoftext|> a@b.co", "fr", "c", 30), (9, "one", "en", "b", 3), (None, None, None, None, None),
    ]).cache()


OPERATORS = {
    "quality": lambda d: quality.ledger(d),
    "mixing": lambda d: mixing.mix(mixing.sized_documents(d)),
    "pii": lambda d: pii.digests(pii.find_spans(d)),
    "exact": lambda d: exact_dedup.deduplicate(d),
    "tokens": lambda d: token_store.read_tokens(token_store.write_tokens(d)),
    "bpe": lambda d: bpe.round_trip(d),
    "language": lambda d: language.predict(d, language.train(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(odd, name):
    assert OPERATORS[name](odd).count() == 12


@pytest.mark.parametrize("name", [*sorted(OPERATORS), "near", "substring"])
def test_empty_table(odd, name):
    more = {"near": near_dedup.near_duplicates, "substring": lambda d: substring_dedup.remove_repeats(d)[0]}
    assert (OPERATORS | more)[name](odd.limit(0)).count() == 0


def test_quality_of_odd_rows(odd):
    rows = {r.doc_id: r for r in quality.ledger(odd.filter("doc_id IS NOT NULL")).collect()}
    for k in (1, 2, 3):
        assert (rows[k].n_words, rows[k].word_chars, rows[k].n_lines, rows[k].fail_bits) == (0, 0, 0, 1)
    assert rows[5].n_words == 30_002 and rows[5].n_repeat_words == 30_000


def test_exact_copies_of_odd_rows(odd):
    rows = exact_dedup.deduplicate(odd).collect()
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.keep_id for r in empty} == {3} and {r.group_size for r in empty} == {4}
    assert [(r.keep_id, r.group_size) for r in rows if r.doc_id in (4, 9)] == [(4, 3)] * 2
    assert sorted((r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id is None) == [(3, 4, False), (4, 3, False)]
    assert {r.keep_id for r in rows if r.doc_id in (5, 6)} == {5}


def test_near_classes_of_odd_rows(odd):
    out = near_dedup.near_duplicates(odd).collect()
    rows = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert len(out) == 12 and sorted(r.class_id for r in out if r.doc_id is None) == [1, 4] and rows[1] == rows[2] == rows[3] == 1 and rows[4] == rows[9] == 4 and rows[5] == rows[6] == 5 and rows[7] == 7 and rows[8] == 8


def test_substrings_of_odd_rows(spark, odd):
    summary, changed = substring_dedup.remove_repeats(odd)
    assert summary.count() == 10
    copies = {r.k for r in summary.filter("copy").collect()}
    assert {6, 9} <= copies and 5 not in copies
    gone = {r.k: r.n_removed for r in changed.collect()}
    assert gone[5] == 30_000 - 1  # of 30,000 equal words the first window alone is new: its first word is in no other


def test_und_and_scores(odd):
    rows = {r.doc_id: r for r in language.predict(odd, language.train(odd)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert rows[5].lang_pred == "de" and 0 <= rows[5].score <= 1
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, "")
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns
    if name == "exact dedup":
        assert sorted((r.doc_id or 0) for r in rows) == [3, 4, 5, 7, 8]
    if name == "near-dedup":
        assert sorted((r.doc_id or 0) for r in rows) == [1, 4, 5, 7, 8]
    assert stage(spark, odd.limit(0), "").count() == 0


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, whole string, turns long"
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
        (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, None, None), (5, 0, "user", "a"), (5, 1, "assistant", "x"),
        (None, 0, "user", "lone"), (None, 0, "user", "lone"), (None, None, None, None), (6, 1, "b", ""), (6, 1, "a", "tie"),
    ]
    out = chat.collapse(spark.createDataFrame([(*r, None, None) for r in rows], schema))
    got = {r.conv_id: r for r in out.filter("conv_id IS NOT NULL").collect()}
    assert set(got) == {2, 4, 5, 6} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[6].rendered.startswith("<|im_start|>a\ntie")
    assert sorted((r.n_copies, r.rendered) for r in out.filter("conv_id IS NULL").collect()) == [(2, "<|im_start|>user\nlone<|im_end|>\n")]
    assert got[4].n_copies == 2  # and the row without id that has the same contents
    assert chat.collapse(spark.createDataFrame([], schema)).count() == 0
