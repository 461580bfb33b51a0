"""Git working trees as sources, and the bound run of an extractor over a source."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import BLOCKED_BINDING, BLOCKED_MISMATCH, PlinthError
from .artifact import V1, V2, make_receipt
from .descriptors import ArchiveSource, GitSource, Runner, load_source
from .materialize import publish_once, source_root, stable_evidence

NO_EXTRACTION = "DEGRADED_EXACT_EXTRACTION_UNAVAILABLE"


def git(folder: Path, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True).stdout
    except (OSError, subprocess.CalledProcessError) as e:
        raise PlinthError(BLOCKED_BINDING, f"{folder} is no readable checkout ({' '.join(args[:2])})") from e


def _line(folder: Path, *args: str) -> str:
    return git(folder, *args).decode().strip()


def repository_name(url: str) -> str | None:
    """owner/name of a hosted address in any of its usual spellings."""
    text = url.strip().removesuffix(".git")
    for start in ("https://github.com/", "git@github.com:", "ssh://git@github.com/"):
        if text.startswith(start):
            return text.removeprefix(start)
    return text if "/" in text and "://" not in text and "@" not in text else None


def tracked_files(spark: SparkSession, root: Path, *, suffix: str = ".lean", excluded: list[str] | None = None) -> DataFrame:
    """source_path of the files under version control, for :func:`readers.read_tree`."""
    names = git(root, "ls-files", "-z", "--", ".").decode().split("\0")
    keep = sorted(n for n in names if n.endswith(suffix) and not any(n.startswith(p) for p in excluded or []))
    return spark.createDataFrame([(n,) for n in keep], "source_path string")


def blob(root: Path, commit: str, path: str) -> bytes:
    """A file as it is in a commit."""
    return git(root, "show", f"{commit}:{path}")


def verify(root: Path, *, repo: str, commit: str, subdir: str) -> None:
    """The tree is a clean checkout of the commit of the repository, and ``root`` its subdir."""

    def mismatch(what: str):
        raise PlinthError(BLOCKED_MISMATCH, what)

    top = Path(_line(root, "rev-parse", "--show-toplevel")).resolve()
    if (found := _line(root, "rev-parse", "HEAD")) != commit:
        mismatch(f"checkout is at {found} instead of {commit}")
    if subdir.startswith("/") or ".." in subdir.split("/") or root.resolve() != (top / subdir).resolve():
        mismatch(f"{root} is not {subdir or '.'} of the checkout")
    origin = _line(top, "remote", "get-url", "origin")
    if repository_name(repo) is None or repository_name(origin) != repository_name(repo):
        mismatch(f"the checkout is of {origin}")
    if _line(top, "status", "--porcelain=v1", "--untracked-files=no", "--", subdir or "."):
        mismatch("the checkout has changes")


def checkout(folder: Path, commit: str) -> None:
    """Puts the working tree at the commit and reads it back."""
    git(folder, "checkout", "--detach", "--quiet", commit)
    if _line(folder, "rev-parse", "HEAD") != commit:
        raise PlinthError(BLOCKED_MISMATCH, f"checkout of {commit} failed")


def toolchain(root: Path) -> str:
    path = root / "lean-toolchain"
    text = path.read_text(encoding="utf-8").strip() if path.is_file() and not path.is_symlink() else ""
    if not text:
        raise PlinthError(BLOCKED_BINDING, f"{path} must be a file that names a toolchain")
    return text


def extract(command: list[str], *, descriptor: bytes, runner: Runner, container: Path, raw: Path, receipt: Path, materialization: Path | None = None) -> bytes:
    """Runs the extractor at the source's root and binds the graph it writes to ``raw``.

    The source is verified before and after; a command that fails, or writes no graph, leaves
    no receipt.
    """
    source = load_source(descriptor)
    root = source_root(source, container)

    def evidence() -> dict | None:
        if isinstance(source, GitSource):
            verify(root, repo=source.source_repo, commit=source.source_commit, subdir=source.source_subdir)
            return None
        if materialization is None:
            raise PlinthError(BLOCKED_BINDING, "an archive needs its materialisation receipt")
        return stable_evidence(source, container, materialization)

    before = evidence()
    tool = toolchain(root)
    raw.parent.mkdir(parents=True, exist_ok=True)
    raw.unlink(missing_ok=True)
    try:
        subprocess.run(command, cwd=root, check=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise PlinthError(NO_EXTRACTION, f"the extractor failed: {e}") from e
    if evidence() != before:
        raise PlinthError(BLOCKED_MISMATCH, "the source changed while it was extracted")
    if not raw.is_file():
        raise PlinthError(NO_EXTRACTION, "the extractor wrote no graph")
    about = {"schema": V2 if isinstance(source, ArchiveSource) else V1, "source": source.authority, "scope": {"root_modules": source.root_modules}, "producer": runner.producer}
    made = make_receipt(about, raw.read_bytes(), tool, before)
    if isinstance(source, GitSource):
        receipt.unlink(missing_ok=True)
    publish_once(receipt, made)
    return made
