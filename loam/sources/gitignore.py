"""Ignore rules of nested .gitignore files, and globs for letting ignored files back in."""

from __future__ import annotations

import re
from functools import lru_cache


@lru_cache(10_000)
def glob_regex(glob: str) -> re.Pattern[str]:
    """A path glob: * and ? stay within a component, ** crosses them, [..] are classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i) and i + 2 == len(glob) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(rf"\A{out}\Z", re.S)


class IgnoreFile:
    """The rules of one .gitignore, which hold below its directory."""

    def __init__(self, text: str, base: str = ""):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+\Z", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            anchored = "/" in line
            pattern = line.lstrip("/") if anchored else "**/" + line
            self.rules.append((negated, only_dirs, glob_regex(pattern)))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: let back in, None: no rule speaks.  The last rule that matches decides."""
        if self.base and not path.startswith(self.base + "/"):
            return None
        local = path[len(self.base) + 1 :] if self.base else path
        for negated, only_dirs, pattern in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(local):
                return not negated
        return None


def ignored(path: str, is_dir: bool, files: list[IgnoreFile]) -> bool:
    """Verdict of the nearest file that speaks; ``files`` run from the root inwards."""
    for f in reversed(files):
        if (v := f.verdict(path, is_dir)) is not None:
            return v
    return False


def include_matcher(globs: list[str]) -> re.Pattern[str] | None:
    """One pattern of the globs that let ignored files back in; empty and negated ones are errors."""
    for g in globs:
        if not g.strip() or g.startswith("!"):
            raise ValueError(f"include pattern {g!r} must be neither empty nor negated")
    return re.compile("|".join(f"(?:{glob_regex(g if '/' in g else '**/' + g).pattern})" for g in globs), re.S) if globs else None
