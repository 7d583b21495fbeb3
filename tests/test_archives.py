from gatehouse.sources import archives, repositories


def test_histories_as_given(spark, tmp_path):
    rows = [("a", 0, "x/1", b"one"), ("a", 0, "2", b"two"), ("a", 1, "2", None), ("a", 1, "x/3", b"\xff"), ("a", 3, "left", b"on disk"), ("b", 0, "../out", b"x"), ("c", 0, "gone", None), ("d", 2, "only", b"late")]
    df = spark.createDataFrame(rows, "repo_id string, revision int, path string, content binary").repartition(3)
    repos = archives.write_archives(df, str(tmp_path / "all"), worktree=2)
    got = {r.repo_id: (r.path, r.error) for r in repos.collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": None, "b": "ValueError", "c": "FileNotFoundError", "d": None}
    assert len({v[0] for v in got.values()}) == 4 and not (tmp_path / "all/out").exists()
    files = {(r.repo_id, r.path, r.tracked, bytes(r.content)) for r in repositories.read_files(repos.where("repo_id in ('a', 'd')")).collect()}
    assert files == {("a", "x/1", True, b"one"), ("a", "x/3", True, b"\xff"), ("a", "left", False, b"on disk"), ("d", "only", False, b"late")}
    assert repositories.read_objects(repos.where("repo_id = 'a'")).count() == 3
    assert archives.write_archives(df.limit(0), str(tmp_path / "none"), worktree=2).count() == 0


def test_shared_folders_by_any_spelling(spark, monkeypatch):
    import pytest

    from gatehouse.sources import staging

    for root, want in (("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b/", "/a/b"), ("viewfs://c/in", None), ("hdfs://n:1/x", None)):
        monkeypatch.setattr(staging, "staging_root", lambda _, r=root: r.rstrip("/"))
        if want:
            assert staging.staging_folder(spark) == want
        else:
            with pytest.raises(ValueError):
                staging.staging_folder(spark)
