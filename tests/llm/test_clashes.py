"""Extra columns whose names clash with those an operator uses or returns change nothing; empty tables give empty results."""

import pytest
from pyspark.sql import functions as F

from locusframe.llm import decontam, html, langid, licenses, neardup, packing, quality, queries, shards, suffix

from .conftest import ODD
from .test_models import TOKENIZER

TEXTS = [*ODD, "Released under the MIT License.", "a plain text of some words that goes on for a while " * 8, "a plain text of some words that goes on for a while " * 8]
BENCH = [(1, "text of some words that goes on for a while"), (None, "")]
OPERATORS = {
    "op1": quality.quality_rules,
    "op2": licenses.scan_licenses,
    "op4": lambda d: suffix.repeated_passages(d),
    "op5": shards.interleave,
    "op6": langid.identify,
    "op7": lambda d: packing.pack(d, TOKENIZER),
    "op8": lambda d: decontam.contamination(d, d.sparkSession.createDataFrame(BENCH, "item_id long, text string")),
    "op9": neardup.near_duplicates,
}
#: Names of outputs and of columns on the way.
NAMES = (
    "body key row _row rows n n_words kept base_failed lost_chars licence dice line n_units unit gram h w template shard slot size law text_crc32 grown_shard at rank pos s part held_out lang_pred score "
    "piece start length ids_crc32 sequence_id offset token tokens window_id spaced n_hit n_items items items_sha256 contaminated n_shingles class_id component_id class label set regs id a b g first "
    "place same same2 more kind spots parts _body _spans _at _part count c k value clean"
).split()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_extra_columns(docs_of, name):
    docs = docs_of(TEXTS, lang=["en"] * len(TEXTS), source=["s"] * len(TEXTS))
    wide = docs.select("*", *[(F.lit(f"x{i}") if i % 2 else F.lit(i)).alias(c) for i, c in enumerate(NAMES)])
    run = lambda d: sorted(map(str, OPERATORS[name](d).collect()))
    assert run(wide) == run(docs)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(docs_of, name):
    full, none = OPERATORS[name](docs_of(["some text"])), OPERATORS[name](docs_of([]))
    assert none.count() == 0 and none.columns == full.columns


def test_kept_rows_and_cleaned_documents_keep_all_columns(docs_of):
    docs = docs_of(TEXTS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    for out in (quality.clean_documents(docs), neardup.kept_rows(docs), suffix.without_repeats(docs), decontam.clean_documents(docs, docs.sparkSession.createDataFrame(BENCH, "item_id long, text string"))):
        rows = out.collect()
        assert out.columns == docs.columns and all(r[c] == i for r in rows for i, c in enumerate(NAMES))


def test_every_query_names_its_operator():
    assert {f"op{i}" for i in range(1, 11)} == {k.split("_")[0] for k in queries.queries()}
    assert callable(html.extract)
