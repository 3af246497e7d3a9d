"""Git's raw and patch output as rows, and line hunks between two texts."""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "status string, base_path string, head_path string, base_blob string, head_blob string, base_mode string, head_mode string"
HUNK = "array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>"
HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_raw(raw: bytes) -> list[dict]:
    """Entries of ``git diff --raw -z``; renames and copies take two paths, zero ids are null."""
    tokens, out, at = raw.split(b"\0"), [], 0
    while at < len(tokens) and tokens[at]:
        old_mode, new_mode, old, new, status = tokens[at].decode().lstrip(":").split()
        first = tokens[at + 1].decode("utf-8", "surrogateescape")
        moved = status[0] in "RC"
        second = tokens[at + 2].decode("utf-8", "surrogateescape") if moved else first
        at += 3 if moved else 2
        blob = lambda x: None if not x.strip("0") else x
        out.append({"status": status[0], "base_path": None if status[0] == "A" else first, "head_path": None if status[0] == "D" else second, "base_blob": blob(old), "head_blob": blob(new), "base_mode": old_mode, "head_mode": new_mode})
    return out


def parse_patch(patch: str) -> dict[str, list[tuple[int, int, int, int]]]:
    """Hunks of a patch without context, by new path (the old one of a deleted file).

    The lengths in a hunk's head tell where it ends, so text that looks like a file's
    head is not taken for one.
    """
    out: dict[str, list[tuple[int, int, int, int]]] = {}
    path, old, left = None, None, 0
    for line in patch.split("\n"):
        if left > 0 and line[:1] in "+- ":
            left -= 2 if line[:1] == " " else 1
            continue
        if line.startswith("--- "):
            old = None if line[4:] == "/dev/null" else line[4:].removeprefix("a/").rstrip("\t")
        elif line.startswith("+++ "):
            path = old if line[4:] == "/dev/null" else line[4:].removeprefix("b/").rstrip("\t")
        elif (m := HEAD.match(line)) and path is not None:
            a, b, c, d = (int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1))
            out.setdefault(path, []).append((a, b, c, d))
            left = b + d
    return out


#: Pairs of lines that are compared at once; longer stretches are cut at lines that stand once on either side.
COMPARED = 4_000_000


def _lines(text: str | None) -> list[str]:
    """Lines as Git counts them: only line feeds end one."""
    found = (text or "").split("\n")
    return found[:-1] if not found[-1] else found


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that stand once in both, the longest run of them that rises in both."""
    once = lambda x: {line: k for k, line in enumerate(x) if n[line] == 1}
    n = Counter(a)
    mine = once(a)
    n = Counter(b)
    pairs = sorted((mine[line], k) for line, k in once(b).items() if line in mine)
    tops, back, at = [], [], []
    for i, (_, k) in enumerate(pairs):
        j = bisect.bisect_left(tops, k)
        back.append(at[j - 1] if j else -1)
        tops[j:], at[j:] = [k, *tops[j + 1 :]], [i, *at[j + 1 :]]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _changes(a: list[str], b: list[str], i: int, k: int):
    """(start, end, start, end) of stretches that differ, by lines counted from i and k."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[len(a) - 1 - last] == b[len(b) - 1 - last]:
        last += 1
    a, b, i, k = a[first : len(a) - last], b[first : len(b) - last], i + first, k + first
    if not a or not b:
        if a or b:
            yield i, i + len(a), k, k + len(b)
    elif len(a) * len(b) <= COMPARED:
        for op, s, e, t, u in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op != "equal":
                yield i + s, i + e, k + t, k + u
    elif not (cuts := _anchors(a, b)):
        yield i, i + len(a), k, k + len(b)
    else:
        s = t = 0
        for x, y in [*cuts, (len(a), len(b))]:
            yield from _changes(a[s:x], b[t:y], i + s, k + t)
            s, t = x + 1, y + 1


def line_hunks(base: str | None, head: str | None) -> list[tuple[int, int, int, int]]:
    """Hunks between two texts in Git's numbers: a side without lines starts at the line before.

    Long stretches without a line that stands once on either side are one hunk.
    """
    a, b = base or "", head or ""
    ends = a[-1:] != "\n", b[-1:] != "\n"
    a, b = _lines(a), _lines(b)
    if a and b and ends[0] != ends[1]:  # a last line without its end is another line
        side = a if ends[0] else b
        side[-1] += "\n"
    return [(i + 1 if j > i else i, j - i, k + 1 if m > k else k, m - k) for i, j, k, m in _changes(a, b, 0, 0)]


def _hunks(batches):
    import pandas as pd

    names = ("old_start", "old_count", "new_start", "new_count")
    for part in batches:
        text = lambda c: None if c is None or b"\0" in bytes(c) else bytes(c).decode("utf-8", "replace")
        found = [[dict(zip(names, h, strict=True)) for h in line_hunks(text(b), text(h))] for b, h in zip(part["base"], part["head"], strict=True)]
        yield pd.DataFrame({"run_id": part["run_id"], "path": part["path"], "hunks": found})


def diff_entries(files: DataFrame) -> DataFrame:
    """(run_id, path, base_path, head_path, base_blob, head_blob, status, is_binary): one row for each path that changed.

    A full outer join of both sides by (run_id, path); moved files of the same
    content are one renamed entry.
    """
    from palisade.operators.snapshots import exact_renames

    side = lambda s: files.where(F.col("side") == s).select("run_id", "path", F.col("blob_id").alias(f"{s}_blob"), F.col("content").alias(f"{s}_content"))
    both = side("base").join(side("head"), ["run_id", "path"], "full_outer").where("not (base_blob <=> head_blob)")
    status = F.when(F.col("base_blob").isNull(), "added").when(F.col("head_blob").isNull(), "deleted").otherwise("modified")
    both = both.withColumn("status", status)
    keyed = both.select(F.struct("run_id", "path").alias("path"), F.struct("run_id", "base_blob").alias("base_blob"), F.struct("run_id", "head_blob").alias("head_blob"), "status")
    moved = exact_renames(keyed).select(F.col("base_key.run_id").alias("run_id"), F.col("base_key.path").alias("old"), F.col("head_key.path").alias("new"))
    zero = F.unhex(F.lit("00"))
    binary = F.coalesce(F.position(zero, F.coalesce("head_content", "base_content")) > 0, F.lit(False))
    out = both.join(moved.select("run_id", F.col("new").alias("path"), "old"), ["run_id", "path"], "left").join(moved.select("run_id", F.col("old").alias("path"), F.lit(True).alias("gone")), ["run_id", "path"], "left")
    out = out.where("gone is null")
    return out.select(
        "run_id", "path", F.when(F.col("old").isNotNull(), F.col("old")).when(F.col("status") != "added", F.col("path")).alias("base_path"), F.when(F.col("status") != "deleted", F.col("path")).alias("head_path"),
        "base_blob", "head_blob", F.when(F.col("old").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), binary.alias("is_binary"), "base_content", "head_content",
    )


def hunks(entries: DataFrame) -> DataFrame:
    """(run_id, path, hunk_no, old_start, old_count, new_start, new_count) of text entries."""
    take = entries.where("not is_binary and status <> 'renamed'").select("run_id", "path", F.col("base_content").alias("base"), F.col("head_content").alias("head"))
    found = take.mapInPandas(_hunks, f"run_id string, path string, hunks {HUNK}")
    return found.select("run_id", "path", F.posexplode("hunks").alias("hunk_no", "h")).select("run_id", "path", "hunk_no", "h.*")
