"""Many small files: written below folders, listed and read by tasks."""

from turnlake.plans.registry import QUERIES
from turnlake.sources import tables as S


def test_files_are_those_of_sparks_reader(spark, tmp_path):
    top = tmp_path / "a docs"
    for name in ("Doc 1.md", "é#%20?.md", "in/x=1/deep.md", "in/other.txt", "_out/no.md", "_k=1/yes.md", ".git/no.md", "in/.no.md", "in/_no.md", "_metadata.md", "empty.md", "in/no.md._COPYING_"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"" if name == "empty.md" else b"\xff" + name.encode())
    top.rename(plain := tmp_path / "docs")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(str(plain)).select("path", "content").collect()
    assert len(want) == 4
    for path in (f"file://{plain}", f"file://{plain}/", f"file:{plain}", str(plain), f"{tmp_path}/do*"):
        assert sorted(map(tuple, S.read_files(spark, path, ".md").collect())) == sorted(map(tuple, want)), path
    assert [r.path for r in S.read_files(spark, f"file://{plain}/Doc 1.md", ".md").collect()] == [f"file:{plain}/Doc 1.md"]
    (plain / "none").mkdir()
    assert S.read_files(spark, f"file://{plain}/none", ".md").collect() == []


def test_many_small_files_do_not_make_many_tasks(spark, tmp_path):
    files = spark.range(2000).selectExpr("concat(cast(id div 64 as string), '/f', cast(id as string), '.md') as name", "concat('---\ntitle: T', cast(id as string), '\n---\nbody') as content")
    assert S.write_files(files, f"file://{tmp_path}/many") == 2000
    found = S.read_markdown(spark, f"file://{tmp_path}/many")
    assert found.filter("text = 'body' and front['title'] = concat('T', substring(doc_id, 2))").count() == 2000
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_the_driver_lists_no_files_of_documents(spark):
    assert "binaryFile" not in QUERIES["s03_read_markdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
