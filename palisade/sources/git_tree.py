"""Trees and blobs of Git revisions as rows."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOB = 64 * 1024 * 1024
FILES = "run_id string, side string, path string, mode string, blob_id string, content binary"
# Fault codes by what Git says (all of these words), in the order they are tried; anything else is a missing object.
FAULTS = [
    (("shallow",), "shallow_history"),
    (("ambiguous", "merge"), "ambiguous_merge_base"),
    (("not a git repository",), "invalid_repository"),
    (("cannot change to",), "invalid_repository"),
    (("unable to read",), "provenance_integrity_error"),
    (("corrupt",), "provenance_integrity_error"),
]


def fault_of(said: str) -> str:
    """The fault code of what a failed Git command said."""
    low = said.lower()
    return next((code for words, code in FAULTS if all(w in low for w in words)), "missing_git_object")


class GitError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail[:200]}")
        self.code = code


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    """Output of a Git command that runs no hooks, filters or helpers of the user's."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_TERMINAL_PROMPT": "0", "GIT_NO_LAZY_FETCH": "1", "LC_ALL": "C"}
    command = ["git", "-C", repo, "-c", f"core.hooksPath={os.devnull}", "-c", "core.fsmonitor=false", "-c", f"core.attributesFile={os.devnull}", "-c", "safe.directory=*", *args]
    try:
        done = subprocess.run(command, input=data, capture_output=True, env=env, timeout=120)
    except (FileNotFoundError, subprocess.TimeoutExpired) as e:
        raise GitError("internal_fault", str(e)) from e
    if done.returncode:
        said = done.stderr.decode("utf-8", "replace")
        raise GitError(fault_of(said), said)
    return done.stdout


def merge_base(repo: str, base: str, head: str, explicit: str | None = None) -> str:
    """The one merge base; several are ambiguous, none means a shallow history.

    An explicit one must be an ancestor of both.
    """
    if any(not x or x.startswith("-") for x in (base, head)):
        raise GitError("invalid_revision", f"{base} {head}")
    if explicit:
        if explicit.startswith("-"):
            raise GitError("missing_git_object", explicit)
        found = git(repo, "rev-parse", "--verify", explicit + "^{commit}").decode().strip()
        for of in (base, head):
            try:
                git(repo, "merge-base", "--is-ancestor", found, of)
            except GitError as e:
                raise GitError("ambiguous_merge_base", "the explicit merge base is not a common ancestor") from e
        return found
    try:
        found = git(repo, "merge-base", "--all", base, head).decode().split()
    except GitError:
        git(repo, "rev-parse", "--verify", base + "^{commit}")
        git(repo, "rev-parse", "--verify", head + "^{commit}")
        found = []
    if len(found) != 1:
        raise GitError("ambiguous_merge_base" if found else "shallow_history")
    return found[0]


def list_tree(repo: str, rev: str) -> list[tuple[str, str, str, str]]:
    """(mode, kind, id, path) of all files of a revision."""
    out = []
    for line in git(repo, "ls-tree", "-r", "-z", rev).split(b"\0"):
        if line:
            head, path = line.split(b"\t", 1)
            out.append((*head.decode().split(), path.decode("utf-8", "surrogateescape")))
    return out


def read_blobs(repo: str, ids: list[str]) -> dict[str, bytes | None]:
    """Contents by id, from one process; too large ones are null."""
    wanted = list(dict.fromkeys(ids))
    out, raw, at = {}, git(repo, "cat-file", "--batch", data="\n".join(wanted).encode() + b"\n") if wanted else b"", 0
    for _ in wanted:
        end = raw.index(b"\n", at)
        head = raw[at:end].decode().split()
        if head[-1] == "missing":
            raise GitError("missing_git_object", head[0])
        size = int(head[2])
        out[head[0]] = raw[end + 1 : end + 1 + size] if size <= MAX_BLOB else None
        at = end + 2 + size
    return out


def snapshots(spark: SparkSession, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """tree files of both sides of runs (run_id, repo, base, head), read on the executors.

    The repositories must be reachable from every executor. A run is one task's work;
    a blob is read once for each run and side pair.
    """

    def read(batches):
        import pandas as pd

        for part in batches:
            for run in part.itertuples():
                trees = {side: list_tree(run.repo, rev) for side, rev in (("base", run.base), ("head", run.head))}
                blobs = read_blobs(run.repo, [i for t in trees.values() for _, kind, i, _ in t if kind == "blob"])
                rows = [(run.run_id, side, path, mode, i, blobs.get(i)) for side, t in trees.items() for mode, kind, i, path in t]
                yield pd.DataFrame(rows, columns=["run_id", "side", "path", "mode", "blob_id", "content"])

    spread = runs.repartition(parts, "run_id") if parts else runs
    return spread.mapInPandas(read, FILES)


def read_path(files: DataFrame, path: str) -> DataFrame:
    """One path's file, of blobs only."""
    return files.where((F.col("path") == path) & ~F.col("mode").isin("160000", "040000"))
