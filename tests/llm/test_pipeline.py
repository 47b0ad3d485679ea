"""The pipeline's stages keep clean documents, act on what they find, and stand odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def table(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    passage, leak = words(1, 60), words(2, 30)
    base = words(3, 200)
    near = base.split()
    near[100] = "changed"
    texts = [(i, words(100 + i, 80)) for i in range(30)]
    texts += [(40, base), (41, " ".join(near)), (42, base), (43, "\ufffd " + words(5, 20) + " " + passage), (44, passage + " " + words(6, 20)), (45, words(7, 15) + " " + leak + " " + words(8, 15)), (46, None), (47, ""), (48, words(9, 80)), (48, words(9, 80))]
    texts += [(60 + i, words(200 + i, 20) + (" you utter moron" if i % 2 else " such an idiot") + ". " + words(300 + i, 10)) for i in range(30)]
    table(spark, texts).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(30)] + [(60 + i, 1, 1) for i in range(28)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, words(11, 20))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), passage


def test_stages_in_turn(spark, data):
    folder, passage = data
    docs = spark.read.parquet(folder + "/documents.parquet")
    clean = {*range(30)}
    after = {}
    for name, stage in C.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        after[name] = docs
        assert name == "tokens" or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {name: sorted(r.doc_id for r in df.collect()) for name, df in after.items()}
    assert not {60 + i for i in range(30)} & set(ids["toxicity"]) and clean | {40, 41, 42, 43, 44, 45, 46, 47, 48} <= set(ids["toxicity"])
    assert {40, 43, 44, 45, 46, 47, 48} | clean <= set(ids["near_duplicates"]) and not {41, 42} & set(ids["near_duplicates"]) and ids["near_duplicates"].count(48) == 1
    texts = {r.doc_id: (r.text, r.n_chars) for r in after["repeated_passages"].collect()}
    assert texts[43][0].startswith("\ufffd ") and passage not in texts[43][0] and passage not in texts[44][0] and all(n == len(t or "") for t, n in texts.values())
    assert 45 not in ids["decontamination"] and set(ids["near_duplicates"]) - {45} == set(ids["decontamination"])
    assert ids["tokens"] == ids["decontamination"] and after["tokens"].filter("n_tokens > 0").count() >= len(clean)


def test_run_gives_the_tokens_of_what_the_stages_keep(spark, data):
    from hashlib import sha256

    from tokenizers import Tokenizer

    from turnlake.llm.bpe_lexicon import default_tokenizer

    folder, _ = data
    docs = spark.read.parquet(folder + "/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    library = Tokenizer.from_file(default_tokenizer())
    packed = lambda text: b"".join(i.to_bytes(4, "little") for i in library.encode(text or "", add_special_tokens=False).ids)
    found = C.run(spark, folder)
    assert found.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect())
    assert got == sorted((r.doc_id, len(packed(r.text)) // 4, sha256(packed(r.text)).hexdigest(), sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())


CLASHING = ("odd_print", "leak_print", "doc", "likely", "fingerprint", "score", "held_out", "predicted", "whole_row", "cut_text", "print", "goes")


def test_columns_of_any_name_and_very_long_texts_stay(spark, data):
    folder, passage = data
    docs = spark.read.parquet(folder + "/documents.parquet")
    long = words(77, 150_000)
    docs = docs.unionByName(table(spark, [(90, long), (91, passage + " " + long), (92, "abc" * 200_000)]))
    plain, named = docs, docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    for name, stage in C.STAGES[:-1]:
        plain, named = (spark.createDataFrame(stage(spark, df, folder).collect(), df.schema) for df in (plain, named))
        assert sorted(map(str, plain.collect())) == sorted(map(str, named.drop(*CLASHING).collect())), name
        assert named.filter(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in CLASHING)).count() == 0
    assert 92 in {r.doc_id for r in plain.collect()}


def test_empty_and_null_tables(spark, data):
    folder, _ = data
    for docs in (table(spark, []), table(spark, [(None, None), (None, "a b c d e f"), (None, "a b c d e f"), (1, None)])):
        for _, stage in C.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        assert docs.filter(F.col("n_tokens").isNull()).count() == 0
