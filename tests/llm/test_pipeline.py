"""Each stage on all that its predecessor kept, against brute force."""

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_components, brute_removal
from tidemark.llm import jaccard, quality, suffixes


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def plain(df):
    return {r.doc_id: tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()}


def test_stages_and_columns(steps):
    assert list(steps) == ["language_id", "quality_rules", "ngram_jaccard", "suffix_dedup", "packing"]
    for name, (before, after) in steps.items():
        assert name == "packing" or after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns
        assert before.count() >= 1


def test_quality_stage_equals_sql(steps):
    before, after = steps["quality_rules"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    assert plain(after) == {k: v for k, v in plain(before).items() if k in kept}


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    before, after = map(plain, steps["ngram_jaccard"])
    root = brute_components(list(before.values()))
    assert after == {k: v for k, v in before.items() if root[k][1] == k}


def test_repeats_are_cut(steps):
    before, after = map(plain, steps["suffix_dedup"])
    want = brute_removal(list(before.values()))
    for k, row in before.items():
        n, removed, _, _ = want[k]
        assert (k in after) == (removed < n or n == 0)
        if k in after:
            assert len(after[k][1].encode()) == n - removed or not row[1].isascii()


def test_packing_holds_every_token(steps):
    before, after = steps["packing"]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {k: len(tokenizer.encode(v[1] or "", add_special_tokens=False).ids) + 1 for k, v in plain(before).items()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_run_gives_the_last_stage(spark, folder, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, steps["packing"][1].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_empty_documents(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_rows_are_not_dropped_by_their_id(spark, rows):
    """Null ids stay to the end, the verdict is the row's own, repeated rows stay once, and -1 is an id like others."""
    good, near = rows[20][1], [r for r in rows if r[1] and len(r[1].split()) > 60][:2]
    bad = "again and again and " * 30
    table = [(None, good, "en", "s", len(good)), (7, near[0][1], "en", "s", 1), (7, bad, "en", "s", 1), (9, near[1][1], "en", "s", 1), (9, near[1][1], "en", "s", 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.quality_rules(spark, docs, "").collect())
    judged = quality.quality_rules(docs.where(f"text <> '{bad}'")).where("kept").count()
    assert (7, bad) not in kept and (0, good) in kept and len(kept) >= judged - 1 and len({k for k, _ in kept}) == 3
    lone = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert lone.count() == 4 and lone.where("doc_id is null").first().text == good
    assert corpus_pipeline.suffix_dedup(spark, lone, "").where("doc_id is null").first().text == good
    found = {(r.doc_id, r.n_removed) for r in suffixes.remove_repeats(docs).collect() if r.doc_id != 7}
    assert found == {(None, 0), (9, 0)}
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(-1, text), (None, text), (5, text + " more")], "doc_id long, text string").repartition(2)
    assert {tuple(r) for r in jaccard.every_document(df).collect()} == {(-1, 36, -1), (5, 37, -1), (None, 36, None)}
