"""Repository files as a table, and its commits (SRC1 to SRC8)."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import subprocess
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicon as L, text as T

MAX_BYTES, PROBED = 2_000_000, 4096


def list_files(root: str) -> list[str]:
    """SRC1: sorted paths that git lists, or else all below the root without
    the folders that are always excluded."""
    if os.path.exists(os.path.join(root, ".git")):
        done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True)
        if done.returncode == 0:
            listed = sorted(set(done.stdout.decode(errors="surrogateescape").split("\0")) - {""})
            return [p for p in listed if os.path.isfile(os.path.join(root, p))]
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in L.EXCLUDED_DIRS]
        out += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
    return sorted(out)


def decode(raw: bytes) -> str | None:
    """SRC4: null for large or binary files; UTF-8, else Latin-1."""
    if len(raw) > MAX_BYTES or b"\0" in raw[:PROBED]:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class IgnoreRules(NamedTuple):
    """SRC3: what a project's settings exclude beside the fixed lists."""

    dirs: frozenset[str] = frozenset()
    files: frozenset[str] = frozenset()
    suffixes: frozenset[str] = frozenset()
    hidden: frozenset[str] = frozenset()


def ignore_rules(settings: str | None) -> IgnoreRules:
    """SRC3 from the text of the settings (JSON); broken ones add nothing.
    Suffixes get their dot."""
    try:
        found = json.loads(settings or "{}")
    except ValueError:
        found = {}

    def texts(key: str) -> frozenset[str]:
        value = found.get(key) if isinstance(found, dict) else None
        return frozenset(str(x) for x in value if str(x)) if isinstance(value, list) else frozenset()

    suffixes = frozenset(x if x.startswith(".") else f".{x}" for x in texts("exclude_extensions"))
    return IgnoreRules(texts("exclude_dirs"), texts("exclude_files"), suffixes, texts("include_hidden_dirs"))


def scan(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """path, language, role, size, extension, modified (UTC seconds), sha256,
    content of the indexable files (SRC1 to SRC6).

    The root must be readable from the executors, which read the files; one
    that has gone or can't be read is left out."""
    rules = rules or IgnoreRules()
    indexable = T.is_indexable(F.col("path"), rules.dirs, rules.files, rules.suffixes, rules.hidden)
    listed = spark.createDataFrame([(p,) for p in list_files(root)], "path string").where(indexable)
    schema = "path string, size bigint, modified string, sha256 string, content string"

    def read(batches):
        for batch in batches:
            rows = []
            for p in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        raw, at = f.read(), os.fstat(f.fileno()).st_mtime
                except OSError:
                    continue
                modified = datetime.datetime.fromtimestamp(int(at), datetime.UTC).isoformat()
                rows.append((p, len(raw), modified, hashlib.sha256(raw).hexdigest(), decode(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["path", "size", "modified", "sha256", "content"])

    out = listed.mapInArrow(read, schema)
    return out.select("path", T.language_of(F.col("path")).alias("language"), T.role_of(F.col("path")).alias("role"), "size", T.extension(F.col("path")).alias("extension"), "modified", "sha256", "content")


def git_log(spark: SparkSession, root: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """SRC7: (commits, commit_files) of the newest ``limit`` commits, from one
    process; both empty outside a repository or without a commit."""
    form = "%x1e%H%x1f%aI%x1f%an%x1f%s"
    done = subprocess.run(["git", "-C", root, "log", f"-n{limit}", f"--pretty=format:{form}", "--name-only", "-z"], capture_output=True)
    commits, touched = [], []
    for k, entry in enumerate(done.stdout.decode(errors="replace").split("\x1e")[1:] if done.returncode == 0 else []):
        head, _, listed = entry.partition("\n")
        sha, date, author, message = (head.strip("\0").split("\x1f") + [""] * 4)[:4]
        commits.append((k + 1, sha, author, date, message))
        touched += [(k + 1, path) for path in dict.fromkeys(listed.split("\0")) if path]
    schema = "id long, hash string, author string, date string, message string"
    return spark.createDataFrame(commits, schema), spark.createDataFrame(touched, "commit_id long, path string")


def git_state(root: str) -> dict[str, str | list[str] | bool]:
    """SRC8: whether git answers, the branch (a short hash if detached) and the
    lines of the short status."""

    def says(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
        except OSError:
            return None
        return done.stdout if done.returncode == 0 else None

    if says("rev-parse", "--is-inside-work-tree") is None:
        return {"available": False, "branch": "", "status": []}
    branch = (says("branch", "--show-current") or "").strip() or (says("rev-parse", "--short", "HEAD") or "").strip()
    return {"available": True, "branch": branch, "status": [line for line in (says("status", "--short") or "").splitlines() if line]}
