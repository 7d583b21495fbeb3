import pytest

from gatehouse.operators import checks

KEY, HOME = "sk-" + "A" * 20, "/home/me/x"


def binary(spark, texts):
    return spark.createDataFrame([(f"r{k}", f"f{k}", x) for k, x in enumerate(texts)], "repo_id string, path string, content binary")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-le"])
def test_keys_and_paths_in_either_encoding(spark, encoding):
    given = [KEY, HOME, KEY.replace("-", "%2D"), HOME.replace("/", "%2f"), "clean 文"]
    files = binary(spark, [("文 " + x).encode(encoding) for x in given])
    assert [r.status for r in checks.secret_scan(files).orderBy("repo_id").collect()] == ["fail", "pass", "fail", "pass", "pass"]
    assert [r.status for r in checks.personal_path_scan(files).orderBy("repo_id").collect()] == ["pass", "fail", "pass", "fail", "pass"]


def test_history_marks_and_decodings_that_fail(spark):
    big = b"\xfe\xff" + KEY.encode("utf-16-be")
    given = [big, KEY.encode("utf-16-be"), KEY.encode() + b"\xff", KEY.encode("utf-16") + b"x", KEY.encode("utf-16") + b"\x00\xd8", None, b""]
    want = ["fail", "pass", "pass", "pass", "pass", "pass", "pass"]
    files = binary(spark, given)
    assert [r.status for r in checks.secret_scan(files).orderBy("repo_id").collect()] == want
    old = files.withColumnRenamed("path", "oid")
    assert [r.status for r in checks.secret_scan(files.limit(0), old).orderBy("repo_id").collect()] == want


def test_texts_count_by_their_bytes(spark):
    files = spark.createDataFrame([("a", KEY.encode("utf-16-le").decode()), ("b", KEY), ("c", "x")], "repo_id string, content string")
    assert [r.status for r in checks.secret_scan(files).orderBy("repo_id").collect()] == ["fail", "fail", "pass"]
