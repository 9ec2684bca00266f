"""Glob dialects, compiled to Java expressions on the driver. The dialects differ on purpose."""

from __future__ import annotations

import re

_META = set(".*+?^${}()|[]\\/-&#~")


def quote(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def braces(pattern: str) -> list[str]:
    """The alternatives of `{a,b}`, innermost first, in order."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for alt in m[1].split(",") for x in braces(pattern[: m.start()] + alt + pattern[m.end() :])]


def task_glob(pattern: str) -> str:
    """Task inputs: leading or inner `**/` spans directories, a final `/**` everything below, other `**` any run;
    `*` and `?` stay in a segment; `[..]`/`[!..]` is a class; a back slash takes the next character as it is."""
    return "|".join(f"(?:^{_task(p)}$)" for p in braces(pattern))


def _task(p: str) -> str:
    out, i = [], 0
    while i < len(p):
        rest = p[i:]
        if rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest == "/**":
            out.append("(?:/.*)?")
            i += 3
        elif rest.startswith("**"):
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "\\" and len(rest) > 1:
            out.append(quote(rest[1]))
            i += 2
        elif rest[0] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            neg = body[:1] in ("!", "^")
            body = body[neg:]
            out.append("[" + "^/" * neg + "".join("\\" + c if c in "\\]^[&" else c for c in body) + "]")
            i = end + 1
        else:
            out.append(quote(rest[0]))
            i += 1
    return "".join(out)


def test_glob(pattern: str) -> str:
    """Test includes and excludes: as above, with `@(a|b)`, `?(a)`, `+(a)`, `*(a)` groups; a pattern without a slash fits at any depth."""
    return "|".join(f"(?:^{_test(p if '/' in p else f'**/{p}')}$)" for p in braces(pattern))


def _test(p: str) -> str:
    out, i = [], 0
    while i < len(p):
        rest = p[i:]
        m = re.match(r"([@?+*])\(([^()]*)\)", rest)
        if m:
            body = "|".join("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else quote(c) for c in alt) for alt in m[2].split("|"))
            out.append(f"(?:{body})" + {"@": "", "?": "?", "+": "+", "*": "*"}[m[1]])
            i += m.end()
        elif rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest.startswith("**"):
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            neg = body[:1] in ("!", "^")
            out.append("[" + "^" * neg + "".join("\\" + c if c in "\\]^[&" else c for c in body[neg:]) + "]")
            i = end + 1
        else:
            out.append(quote(rest[0]))
            i += 1
    return "".join(out)


def segment_glob(pattern: str) -> str:
    """Plain wildcards as in workflow path filters and pytest's python_files: `*` within a segment, no classes or braces."""
    body = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else "".join(map(quote, x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))
    return f"^{body}$"


def route(path: str) -> str:
    """An application route: `[x]` one segment, `[...x]` one or more, `[[...x]]` any number; `(group)` segments vanish."""
    out = ""
    for s in path.strip("/").split("/"):
        if not s or re.fullmatch(r"\(.*\)", s):
            continue
        if re.fullmatch(r"\[\[\.\.\..*\]\]", s):
            out += "(?:/.*)?"
        elif re.fullmatch(r"\[\.\.\..*\]", s):
            out += "/.+"
        elif re.fullmatch(r"\[.*\]", s):
            out += "/[^/]+"
        else:
            out += "/" + "".join(map(quote, s))
    return f"^{out or '/'}/?$"
