import subprocess

from palisade.sources import diffs, git_tree, policies
from palisade.sources.facts import file_facts, python_facts, script_facts


def test_raw_and_patch():
    raw = b":100644 100644 aaa bbb M\0a.py\0:100644 000000 ccc 000 D\0b.py\0:100644 100644 ddd eee R090\0old.py\0new.py\0"
    got = diffs.parse_raw(raw)
    assert [(e["status"], e["base_path"], e["head_path"]) for e in got] == [("M", "a.py", "a.py"), ("D", "b.py", None), ("R", "old.py", "new.py")]
    assert got[1]["head_blob"] is None
    patch = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1 @@\n--- removed text\n-- more\n+one\n@@ -9,0 +9,2 @@\n+a\n+b\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    assert diffs.parse_patch(patch) == {"x.sql": [(1, 2, 1, 1), (9, 0, 9, 2)], "gone": [(1, 1, 0, 0)]}
    assert diffs.line_hunks("a\nb\nc\n", "a\nx\nc\nd\n") == [(2, 1, 2, 1), (3, 0, 4, 1)]


def test_python_facts():
    f = python_facts("pkg/m.py", b"__all__ = ['f']\nfrom . import x as y\n@deco\ndef f(a, /, b, c=1, *d, e, g=2, **h):\n    z = 1\n    return z(a, *d, k=1)\nclass C:\n    async def m(self):\n        getattr(self, 'f')()\n")
    assert [(e["qname"], e["kind"], e["start_line"], e["is_export"], e["is_async"]) for e in f["entities"]] == [("pkg/m:f", "function", 3, True, False), ("pkg/m:C", "class", 7, True, False), ("pkg/m:C.m", "method", 8, False, True)]
    assert [p["kind"] for p in f["entities"][0]["params"]] == ["posonly", "positional", "positional", "vararg", "kwonly", "kwonly", "kwarg"]
    assert f["calls"][0] == {"callee": "z", "line": 6, "end_line": 6, "positional": 1, "keywords": ["k"], "star": True, "kwargs": False, "shadowed": True}
    assert f["dynamic"] and f["unknown_decorator"] and f["imports"][0]["level"] == 1
    assert python_facts("a.py", b"x = (")["parse_error"] and python_facts("a.py", b"(" * 300)["parse_error"]
    assert python_facts("a.py", b"x" * (3 << 20))["parse_error"].startswith("parse_resource_limit")


def test_script_facts():
    f = script_facts("a/b.ts", b"import { foo as bar } from './lib';\nexport function f(a: number, b?: string, ...c: any[]) { return bar(a, {x: 1}); }\nclass K { async go(x = 1) { this.h(x); } }\nconst g = async (u) => { eval(u); };\n// f(\nlet s = \"g(\";\n")
    assert [(e["qname"], e["kind"], e["is_export"], e["is_async"]) for e in f["entities"]] == [("a/b:f", "function", True, False), ("a/b:K", "class", False, False), ("a/b:K.go", "method", False, True), ("a/b:g", "arrow", False, True)]
    assert [c["callee"] for c in f["calls"]] == ["bar", "this.h", "eval"] and f["calls"][0]["keywords"] == ["x"] and f["dynamic"]
    assert script_facts("a.ts", b"function f( {")["parse_error"]
    assert file_facts("README.md", b"")["language"] == "text" and not file_facts("a.go", b"")["supported"]


def test_policy_and_owners(spark):
    import pytest

    day = '[[waivers]]\nid = "w"\ncreated = 2026-01-01\nexpires = {}\nfingerprint = "sha256:' + "a" * 64 + '"\n'
    assert policies.parse_policy(day.format("2026-03-01").encode())["waivers"][0]["expires"] == "2026-03-01"
    for bad in (b"[x]\n", b"\xff", b'[deny.R]\npaths = ["/a"]\n', day.format("2027-03-01").encode(), day.format("2025-03-01").encode()):
        with pytest.raises(policies.PolicyError):
            policies.parse_policy(bad)
    rules = policies.parse_codeowners("# all\n* @all\n/src/ @src # inline\ndocs/*.md @docs @x\nMakefile @make\n")
    paths = spark.createDataFrame([("a",), ("src/x/y.py",), ("docs/a.md",), ("d/Makefile",), ("Makefile",)], "path string")
    got = {r.path: (r.rule, list(r.owners)) for r in policies.owners_of(paths, rules).collect()}
    assert got == {"a": (0, ["@all"]), "src/x/y.py": (1, ["@src"]), "docs/a.md": (2, ["@docs", "@x"]), "d/Makefile": (3, ["@make"]), "Makefile": (3, ["@make"])}


def test_git_snapshots(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b.txt").write_text("new\n")
    run("add", ".")
    run("commit", "-qm", "two")
    base = git_tree.merge_base(str(tmp_path), "HEAD~1", "HEAD")
    runs = spark.createDataFrame([("r", str(tmp_path), base, "HEAD")], "run_id string, repo string, base string, head string")
    files = git_tree.snapshots(spark, runs)
    assert {(r.side, r.path, bytes(r.content)) for r in files.collect()} == {("base", "a.py", b"x = 1\n"), ("head", "a.py", b"x = 2\n"), ("head", "b.txt", b"new\n")}
    entries = diffs.diff_entries(files)
    assert {(r.path, r.status) for r in entries.collect()} == {("a.py", "modified"), ("b.txt", "added")}
    assert [(r.path, r.old_start, r.new_count) for r in diffs.hunks(entries).orderBy("path").collect()] == [("a.py", 1, 1), ("b.txt", 0, 1)]
    try:
        git_tree.list_tree(str(tmp_path), "nope")
    except git_tree.GitError as e:
        assert e.code in ("missing_git_object", "provenance_integrity_error")


def test_lines_end_as_git_ends_them():
    from palisade.sources.diffs import line_hunks

    assert line_hunks("a\x0cb\nc\n", "a\x0cb\nd\n") == [(2, 1, 2, 1)]
    assert line_hunks("a\x85b\u2028c\n", "a\x85b\u2028c\nd\n") == [(1, 0, 2, 1)]
    assert line_hunks("a\nb", "a\nb\n") == [(2, 1, 2, 1)]
    assert line_hunks("a\r\nb\n", "a\nb\n") == [(1, 1, 1, 1)]
    assert line_hunks(None, "x\n") == [(0, 0, 1, 1)] and line_hunks("", "") == []


def test_long_texts_of_equal_lines_take_seconds():
    import random
    import time

    from palisade.sources.diffs import line_hunks

    began, blank = time.time(), "\n" * 100_000
    assert line_hunks(blank, blank + "x\n" + blank) == [(100_000, 0, 100_001, 100_001)]
    rng = random.Random(1)
    lines = [f"line {k}" if rng.random() < 0.5 else "" for k in range(60_000)]
    other = list(lines)
    for k in range(0, 60_000, 7000):
        other[k] = f"changed {k}"
    assert line_hunks("\n".join(lines) + "\n", "\n".join(other) + "\n") == [(k + 1, 1, k + 1, 1) for k in range(0, 60_000, 7000)]
    assert time.time() - began < 30


def test_faults_of_git():
    from palisade.sources.git_tree import fault_of

    said = {
        "fatal: ambiguous argument 'x': unknown revision or path not in the working tree.": "missing_git_object",
        "fatal: Not a valid object name x": "missing_git_object",
        "fatal: cannot change to '/none': No such file or directory": "invalid_repository",
        "fatal: not a git repository (or any of the parent directories): .git": "invalid_repository",
        "error: object file is corrupt": "provenance_integrity_error",
        "fatal: unable to read tree": "provenance_integrity_error",
        "fatal: attempt to fetch from a shallow clone": "shallow_history",
        "fatal: ambiguous merge base": "ambiguous_merge_base",
        "anything": "missing_git_object",
    }
    assert {k: fault_of(k) for k in said} == said


def test_guards_of_scripts():
    from palisade.plans.semantics import script_guards

    one = lambda code: [(n, line, set(u)) for n, line, u in script_guards(code, "go")]
    assert one("function f(a) {\n  if (!a) { return; }\n  // go(0)\n  go(1);\n}") == [("f", 4, {"not (!a)"})]
    assert one("class C {\n  m(a) {\n    if (a) go(1); else { go(2); }\n  }\n}")[0] == ("m", 3, {"a"})
    assert one("const f = (a) => {\n  if (!a) return;\n  x.go(a);\n};") == [("f", 3, {"not (!a)"})]
    assert one("function f(a, b) {\n  if (a) {\n    x();\n  } else if (b) {\n    go();\n  }\n}") == [("f", 5, {"b", "not (a)"})]
    assert one('function f(a) {\n  s = "if (x) { go(1) }";\n  a && go(2);\n}')[-1][2] == {"&& a"}
    assert one("function f() {\n  go();\n}\nfunction go() {}\n") == [("f", 2, set())]
