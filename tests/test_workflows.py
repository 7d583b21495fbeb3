import random

from pyspark.sql import functions as F

from gatehouse.functions import globs, workflows

HEAD = b"jobs:\n  test:\n    steps:\n"


def test_lines_of_actions():
    lines = workflows.action_lines
    assert lines(HEAD + b"      - uses: a/b@c\n        with:\n          uses: no\n      - name: x\n        uses: a/b@c\r\n") == [4, 8]
    assert lines(b"jobs:\n  r:\n    uses: o/w/.github/workflows/t.yml@c\n  s:\n    env:\n      uses: x\n") == [3]
    assert lines(HEAD + b"      - run: |\n          uses: a/b@c\n\n        # note\n      - uses: a/b@c") == [8]
    assert lines(b"on: push\nenv:\n  uses: a/b@c\n") == []
    assert lines(b"") == []
    for bad in (b"    env: {", b"    env: [a", b"    run: &x y", b"    run: !t y", b"    run: 'open", b'    run: "open', b'    run: "x\\"', b"\t    run: x", b"      text", b"  - a: b", b" a: b", b"       - uses: a/b@c\n      - uses: a/b@c"):
        assert lines(HEAD + bad + b"\n") is None, bad
    assert lines(b"text\n" + HEAD + b"      - uses: x") == [5]


def test_versions_that_move_pins_only(spark):
    pin = lambda sha, action=b"a/b", tail=b"", lead=b"      - uses: ": lead + action + b"@" + sha * 40 + tail + b"\n"
    rest = b"      - run: x\n"
    cases = [
        (pin(b"1") + rest, pin(b"2") + rest, True),
        (pin(b"1", tail=b" # v1") + rest, pin(b"2", tail=b"\t# v2 \xff ") + rest, True),
        (pin(b"1") + pin(b"1"), pin(b"1") + pin(b"3"), True),
        (pin(b"1") + rest, pin(b"1") + rest, False),
        (pin(b"1") + rest, pin(b"2") + rest + rest, False),
        (pin(b"1") + rest, pin(b"2") + b"      - run: y\n", False),
        (pin(b"1"), pin(b"2", action=b"evil/b"), False),
        (pin(b"1"), pin(b"2", tail=b"#v2"), False),
        (pin(b"1"), pin(b"2", lead=b"      -  uses: "), False),
        (pin(b"1"), b"      - uses: a/b@main\n", False),
        (pin(b"1") + b"    env: {}\n", pin(b"2") + b"    env: {}\n", False),
        (pin(b"1"), None, False),
    ]
    df = spark.createDataFrame([(k, HEAD + b, None if a is None else HEAD + a) for k, (b, a, _) in enumerate(cases)], "k int, b binary, a binary")
    both = df.select("k", *[c for s in "ba" for c in (workflows.byte_lines(F.col(s)).alias(f"{s}l"), workflows.action_line_numbers(F.col(s)).alias(f"{s}n"))])
    got = {r.k: r.ok for r in both.select("k", workflows.moves_pins_only(F.col("bl"), F.col("al"), F.col("bn"), F.col("an")).alias("ok")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_globs_meet_the_paths_that_they_match(spark):
    import re

    rng = random.Random(4)
    words = ["a", "b", "src", "docs", "x.md", "y.py", "t.test.js", "**", "*", "*.md", "?", "[ab]", "s*c"]
    some = ["**/*.png", "docs/**", "**/auth/**", "*", "README.md", "a**/b", "src/*.py", ".github/workflows/**", "*.test.js", "[!a]*"] + ["/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    paths = ["README.md", "x/README.md", "auth/k", "a/auth/k.pem", "i.png", ".github/workflows/c.yml", "ab"] + ["/".join(rng.choice(words[:7]) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    g = spark.createDataFrame([("r", x, k) for k, x in enumerate(some)], "repo_id string, glob string, k int").unionByName(spark.createDataFrame([("other", "*", -1), ("r", None, -2)], "repo_id string, glob string, k int"))
    p = spark.createDataFrame([("r", x) for x in paths] * 2, "repo_id string, path string")
    got = globs.glob_matches(g, p).collect()
    want = {(k, x) for k, y in enumerate(some) for x in set(paths) if re.search(globs.glob_regex(y), x)}
    assert {(r.k, r.path) for r in got} == want and len(got) == len(want)
    assert globs.glob_keys("src/123/**") == ["2:src/123"] and globs.glob_keys("**/*.md") == ["e:md"] and globs.glob_keys("*") == ["*"]
