"""The stored index against searches of the texts themselves, over writes, refreshes and deletions."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import postings, search

DOCS = {1: ("Apache license", "the apache license version two, license"), 2: ("notes", "no such word here"), 3: (None, "license apache and far " + "x " * 30 + "apache"), 4: ("", None), 5: ("Ünïcode", "Äpfel license-apache license apache")}


def table(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id long, title string, text string")


def expected(spark, docs, query, excluded=""):
    index = search.build_index(table(spark, docs), "doc_id", ["title", "text"])
    return sorted((r.doc_id, r.tier, round(r.score, 9)) for r in search.ranked_matches(index, "doc_id", query, excluded).collect())


def test_one_pass_search_equals_the_index(spark):
    for query, excluded in (("apache license", ""), ("license", "two"), ("äpfel", ""), ("nothing", "")):
        rows, lengths = search.term_rows(table(spark, DOCS), "doc_id", ["title", "text"], search.words_of(f"{query} {excluded}"))
        got = search.ranked_matches(rows, "doc_id", query, excluded, lengths=lengths).collect()
        assert sorted((r.doc_id, r.tier, round(r.score, 9)) for r in got) == expected(spark, DOCS, query, excluded)


def test_refreshed_index(spark, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path / "index"), "doc_id", ["title", "text"], buckets=8)

    def found(query):
        rows, lengths = index.select(search.words_of(query))
        return sorted((r.doc_id, r.tier, round(r.score, 9)) for r in search.ranked_matches(rows, "doc_id", query, lengths=lengths).collect())

    with pytest.raises(FileNotFoundError):
        index.documents()
    now = dict(DOCS)
    index.write(table(spark, now).unionByName(spark.createDataFrame([(None, "apache license", "x")], "doc_id long, title string, text string")))
    assert found("apache license") == expected(spark, now, "apache license")
    now |= {2: ("apache", "license now"), 6: ("new", "apache license")}
    del now[1], now[4]
    index.refresh(table(spark, {k: now[k] for k in (2, 6)}), spark.createDataFrame([(1,), (4,), (77,)], "doc_id long"))
    assert found("apache license") == expected(spark, now, "apache license")
    now[1] = ("back", "license apache again")
    index.refresh(table(spark, {1: now[1]}), spark.createDataFrame([(1,)], "doc_id long"))
    assert found("apache license") == expected(spark, now, "apache license") and found("two") == []
    index.write(table(spark, {9: ("apache", "license")}))
    assert found("apache license") == expected(spark, {9: ("apache", "license")}, "apache license")
    index.refresh(table(spark, DOCS).limit(0), spark.createDataFrame([(9,)], "doc_id long"))
    assert found("apache license") == []
    rows, _ = index.select(["apache"])
    paths = {p.rsplit("/", 2)[-2] for p in rows.inputFiles() if "/postings/" in p}
    assert len(paths) == 1  # one word, one bucket


def test_index_of_an_empty_table(spark, tmp_path):
    index = postings.PostingIndex(spark, str(tmp_path / "index"), "doc_id", ["text"])
    index.write(table(spark, DOCS).limit(0))
    rows, lengths = index.select(["apache"])
    assert rows.count() == lengths.count() == 0 and rows.select(F.max("pos")).first()[0] is None
