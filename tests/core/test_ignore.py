import pytest

from lorequarry.operators import ignore as ig

KINDS = {".gitignore": 1, ".dockerignore": 2, ".localignore": 3}
#: Some usual default rules.
DEFAULTS = ["node_modules/", ".git/", "*.min.js", "*.png", "*.sqlite"]


def tree(spark, files, exclude=(), include=(), defaults=DEFAULTS):
    rules = ig.configured(spark, defaults, "builtin", 0)
    rules = rules.unionByName(ig.configured(spark, exclude, "config:exclude", 4)).unionByName(ig.configured(spark, [f"!{p}" for p in include], "config:include", 5, explicit=True))
    return rules, spark.createDataFrame(list(files.items()), "path string, text string")


def decisions(spark, rules, paths):
    return {r.path: (r.ignored, r.source) for r in ig.decide(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}


def pruned(spark, rules, dirs):
    return {r.path for r in ig.prunable(spark.createDataFrame([(p,) for p in dirs], "path string"), rules).collect()}


@pytest.mark.parametrize(
    ("line", "fits", "not_"),
    [
        ("*.log", ["a.log", "x/y/b.log", "c.log/in.txt"], ["a.logs"]),
        ("/build", ["build", "build/x"], ["a/build"]),
        ("build/", ["build/x", "a/build/x"], ["build"]),
        ("docs/**", ["docs/a", "docs/a/b"], ["docs", "x/docs/a"]),
        ("**/keep.txt", ["keep.txt", "a/b/keep.txt"], ["a/keep.txt2"]),
        ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["az", "b/a/z"]),
        ("f?[0-9].[!x]", ["fa1.y", "d/fa1.y"], ["fa1.x", "f/1.y", "fab.y"]),
        (r"\#x ", ["#x"], ["x"]),
    ],
)
def test_globs(line, fits, not_):
    import re

    regex, include = ig.regex_of(line)
    assert include and all(re.search(regex, p) for p in fits) and not any(re.search(regex, p) for p in not_)
    assert ig.regex_of("# no") is None and ig.regex_of("  ") is None and ig.regex_of("!a")[1] is False


def test_nested_sources_negations_and_origins(spark):
    given, files = tree(spark, {".gitignore": "*.log\nbuild/\n", "src/.gitignore": "tmp.py\n", ".localignore": "docs/**\n!docs/keep.md\n"})
    rules = given.unionByName(ig.found(files, KINDS))
    asked = ["app.log", "app.py", "src/tmp.py", "tmp.py", "docs/interno.md", "docs/keep.md", "node_modules/x.js", ".git/config", "a.min.js", "img.png", "x.sqlite", ".env", "src\\tmp.py"]
    got = decisions(spark, rules, asked)
    ignored = {p for p, (d, _) in got.items() if d}
    assert ignored == {"app.log", "src/tmp.py", "docs/interno.md", "node_modules/x.js", ".git/config", "a.min.js", "img.png", "x.sqlite"}
    assert got["app.log"][1] == ".gitignore" and got["src/tmp.py"][1] == "src/.gitignore" and got["app.py"] == (False, None)


PATHS = ["src/app.py", "build/x.txt", "build/keep.txt", "node_modules/pkg/.env.example", "node_modules/pkg/index.js", "node_modules/keep/a.js", ".env.example"]
DIRS = ["node_modules", "node_modules/keep", "node_modules/pkg", "build", "src"]


@pytest.mark.parametrize(
    ("text", "include", "want"),
    [
        ("build/\n!.env.example\n", (), {"node_modules", "node_modules/keep", "node_modules/pkg", "build"}),
        ("build/\n!build/keep.txt\n", (), {"node_modules", "node_modules/keep", "node_modules/pkg"}),
        ("", ("node_modules/keep/**",), {"node_modules/pkg"}),
        ("", ("*.js",), set()),
    ],
)
def test_pruning(spark, text, include, want):
    given, files = tree(spark, {".gitignore": text}, include=include)
    assert pruned(spark, given.unionByName(ig.found(files, KINDS)), DIRS) == want


def test_walk_skips_pruned_folders_and_the_rules_in_them(spark):
    given, files = tree(spark, {".gitignore": "build/\n!build/keep.txt\n!.env.example\n", "node_modules/pkg/.gitignore": "!index.js\n!src/app.py", "src/.gitignore": "gen/", "src/gen/.gitignore": "!x.py"})
    paths = spark.createDataFrame([(p,) for p in [*PATHS, "src/gen/x.py"]], "path string")
    got = {r.path: r.ignored for r in ig.walk(paths, given, files, KINDS).collect()}
    assert got == {"src/app.py": False, "build/x.txt": True, "build/keep.txt": False, ".env.example": False}
    assert ig.walk(paths.limit(0), given, files, KINDS).count() == 0
    assert decisions(spark, given.limit(0), ["a"]) == {"a": (False, None)}
