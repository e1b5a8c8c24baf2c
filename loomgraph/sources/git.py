"""A working copy's state through the git command: short path lists, and the commit log as a file for the distributed reader."""

from __future__ import annotations

import subprocess


def _git(repo: str, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", repo, *arguments], capture_output=True, text=True, timeout=60)
    return done.stdout if done.returncode == 0 else ""


def changed(repo: str, scope: str = "head", ref: str = "") -> list[str]:
    """Changed paths: unstaged, staged, head (either), commit (since ref) or branch (since the merge base with ref); none outside a repository."""
    if scope == "branch":
        ref = _git(repo, "merge-base", "HEAD", ref or "main").strip()
        if not ref:
            return []
    extra = {"unstaged": [], "staged": ["--cached"], "head": ["HEAD"], "commit": [ref or "HEAD~1"], "branch": [ref]}[scope]
    return sorted(x for x in _git(repo, "diff", "--name-only", *extra).split("\n") if x)


def write_log(repo: str, path: str, commits: int | None = None) -> None:
    """Write the log in the form that sources.logs.commits reads."""
    with open(path, "w") as f:
        f.write(_git(repo, "log", *([f"--max-count={commits}"] if commits else []), "--name-only", "--pretty=format:COMMIT_SEP %H %ct"))
