"""Stages of the corpus pipeline on small tables with odd rows."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, mark long, gone long, passes long"


def words(r, n):
    return " ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(90)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    rows = {k: "\n".join(words(r, 40) for _ in range(3)) for k in range(60)}
    toxic = [k for k in rows if k % 6 == 0]
    for k in toxic:
        rows[k] += " you blorgface you zorkel blorgface"
    rows[101] = rows[1] + " more"                                        # a near copy that shares lines too
    rows[102] = " ".join(rows[2].split()[:110] + ["other"] + rows[2].split()[111:])  # a near copy in one line
    rows[103] = rows[3].split("\n")[0] + "\n" + words(r, 70)            # shares a line
    docs = [(k, t, "en", "s" if k % 3 else None, len(t), 1, 2, 3, 4) for k, t in rows.items()]
    docs += [docs[5], (None, words(r, 60), None, "s", 0, 1, 2, 3, 4), (200, None, None, None, None, 1, 2, 3, 4), (201, "", "en", "s", 0, 1, 2, 3, 4)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k in toxic)) for k in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, toxic


def test_stages(spark, tables):
    path, rows, toxic = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = corpus_pipeline.reject_toxic(spark, docs, path)
    assert one.columns == docs.columns
    left = {x["doc_id"] for x in one.select("doc_id").collect()}
    assert not left & set(toxic) and left >= {k for k in rows if k not in toxic}
    two = corpus_pipeline.drop_line_copies(spark, one, path)
    assert two.columns == docs.columns
    text = {x["doc_id"]: x["text"] for x in two.collect()}
    assert text[103] == rows[103].split("\n")[1] and text[3] == rows[3] and text[200] is None and text[201] == "" and text[101] == rows[101].split("\n")[2]
    three = corpus_pipeline.drop_near_copies(spark, one, path)
    kept = [x["doc_id"] for x in three.select("doc_id").collect()]
    assert three.columns == docs.columns and len(kept) == len(set(kept)) and None in kept
    assert {101, 102} & set(kept) == set() and {1, 2, 3, 103, 200, 201} <= set(kept)
    both = docs.limit(1).selectExpr("7L as doc_id", "'another text of the same document' as text", *docs.columns[2:])
    again = corpus_pipeline.drop_near_copies(spark, one.union(both), path)
    assert again.where("doc_id = 7").count() == 2
    four = corpus_pipeline.mix_sources(spark, three, path)
    assert four.columns == docs.columns and {200, 201} & {x["doc_id"] for x in four.collect()} == set()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, path).count() == 0


def test_run_twice(spark, tables):
    pytest.importorskip("public_tokenizers")
    key = lambda: sorted((x["doc_id"] is None, x["doc_id"] or 0, x["start"], x["length"], x["ids_crc32"]) for x in corpus_pipeline.run(spark, tables[0]).collect())
    first = key()
    assert first == key() and sum(x[3] for x in first) > 1000
