"""Every query with an oracle against DuckDB on the smallest tables; the others make rows."""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata

import duckdb
import numpy as np
import pytest

from varve import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Few rows of these tables leave nothing to report.
MAY_BE_EMPTY = {"txt_search_filtered", "aud_idle_cursors", "aud_same_counts", "aud_loose_groups", "flagship", "ing_dead_urls", "spc_distributions", "txt_search", "api_better_alternatives", "api_comparables", "flt_many_criteria", "api_competing_offers", "aud_empty_roots", "api_spec_facets"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    number = lambda v: isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool)
    return sorted(tuple(repr(float(v)) if number(v) else repr(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    assert len(got) or name in MAY_BE_EMPTY


def test_whole_texts_of_all_languages_are_folded(spark, tmp_path):
    texts = {1: ("fr", "É" + "a" * 500 + " Ça très"), 2: ("de", "x" * 450 + " Ärger ß Öl"), 3: ("es", "Niñez"), 4: ("fr", ""), 5: ("en", None)}
    spark.createDataFrame([(k, t, lang) for k, (lang, t) in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.folded for r in catalogue.queries()["scl_fold_whole_texts"](spark, str(tmp_path)).collect()}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    assert got == {k: None if t is None else hashlib.md5(re.sub("[^a-z0-9]+", "-", plain(t)).encode()).hexdigest() for k, (_, t) in texts.items()}
