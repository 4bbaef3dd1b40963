import corpus_pipeline as C

from quillspark.llm import linededup, minhash, packing, quality
from quillspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]
    tables = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, tables[-1], SF).cache()
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        tables.append(out)
    good, lines, single, mixed, packed = tables[1:]
    assert quality.keep_good(good, quality.POLICIES["full-1"]).count() == good.count()
    assert linededup.repeated_lines(lines).where("size(removed) > 0").count() == 0
    assert minhash.classes(single).where("NOT kept").count() == 0
    assert {r[0] for r in mixed.select("doc_id").collect()} <= {r[0] for r in single.select("doc_id").collect()}
    encoder = packing.Encoder(tokenizer_path())
    tokens = sum(len(ids) // 4 + 1 for ids in encoder.encode([r["text"] for r in mixed.collect()]))
    assert packed.selectExpr("sum(length)").first()[0] == tokens
    key = lambda r: (r["doc_id"], r["start"], r["sequence_id"], r["offset"], r["ids_crc32"])
    assert sorted(map(key, C.run(spark, SF).collect())) == sorted(map(key, packed.collect()))


def test_an_empty_table_gives_no_sequence(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
