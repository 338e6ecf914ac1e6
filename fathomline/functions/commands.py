"""Shell commands and paths in agent transcripts: which files a command names, and what it does to them.

These parse quoting and follow ``cd`` through a command, which built-in functions can't; they run as
Arrow-batched user functions over arrays.
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Commands that run their files, words that wrap a command, tools whose run or exec wraps one.
RUNNING = frozenset(
    "pytest py.test python python3 node deno bun ruby php bash sh zsh go cargo npm pnpm yarn jest vitest mocha rspec tox nox make just java swift dotnet "
    "mvn gradle gradlew tsx ts-node phpunit lua mix elixir dart flutter Rscript julia".split()
)
WRAPPING = frozenset("sudo time env nice command exec xargs npx bunx".split())
RUNNERS = frozenset("uv poetry pipenv pdm hatch rye pnpm yarn npm".split())
#: Actions by strength.
ACTIONS = ("read", "ran", "edited")


def path_of(token: str) -> str | None:
    """A word of a command line as a path, or None for flags, URLs, globs and numbers."""
    token = token.rstrip(",;):")
    if not token or "://" in token or re.search(r"[*?\[\]$]", token):
        return None
    token = token.split("::")[0].split("#")[0]
    token = re.sub(r"^([^:]*):\d+(?::\d+)*$", r"\1", token)
    token = token.removeprefix("./")
    return None if token in ("", ".", "..") or re.fullmatch(r"[0-9]+", token) else token


def words_of(segment: str) -> list[str]:
    spaced = re.sub(r"[\"'`(){}]", " ", segment)
    spaced = re.sub(r">(?:\s*>)*", " > ", spaced).replace("<", " < ")
    return spaced.split()


def _skip_wrappers(words: list[str]) -> int:
    i = 0
    while i < len(words):
        name = words[i]
        if re.match(r"\w+=", name) or name in WRAPPING:
            i += 1
        elif name == "timeout" or (name in RUNNERS and i + 1 < len(words) and words[i + 1] in ("run", "exec")):
            i += 2
        else:
            break
    return i


def _action(name: str, args: list[str]) -> str:
    in_place = {
        "sed": any(a.startswith("-i") or a == "--in-place" for a in args),
        "perl": any(re.match(r"-(?!-).*i", a) for a in args),
    }.get(name, name in ("tee", "touch", "truncate"))
    return "edited" if in_place else "ran" if name in RUNNING else "read"


def shell_touches(command: str) -> list[tuple[str, str]]:
    """(path, action) of the files a command names, in order; paths follow ``cd`` inside the command."""
    base, out = "", []
    for segment in re.split(r"&&|\|\||[\n;|&]", command):
        words = words_of(segment)
        start = _skip_wrappers(words)
        if start >= len(words):
            continue
        first, args = words[start], words[start + 1 :]
        name = first.rsplit("/", 1)[-1]
        if name == "cd":
            base = posixpath.join(base, args[0]) if args else base
            continue
        usual = _action(name, args)
        if "/" in first and (p := path_of(first)):
            out.append((posixpath.join(base, p), "ran"))
        redirect = None
        for a in args:
            if a in "><":
                redirect = "edited" if a == ">" else "read"
                continue
            action, redirect = redirect or usual, None
            if a.startswith("-") and action is usual:
                _, eq, a = a.partition("=")
                if not eq:
                    continue
            if p := path_of(a):
                out.append((posixpath.join(base, p), action))
    return out


def relative_to(root: str, path: str) -> str | None:
    """A path below the root, from it, or None outside; /tmp and /private/tmp are one place."""
    full = posixpath.normpath(posixpath.join(root, path))
    other = root.removeprefix("/private") if root.startswith("/private/") else "/private" + root
    for r in (root, other):
        r = r.rstrip("/")
        if full.startswith(r + "/"):
            return full[len(r) + 1 :]
    return None


def touched(calls: list[dict], root: str, hinted: list[str], existing: set[str] | None = None) -> list[tuple[str, str]]:
    """Paths touched in the calls after an answer, by first touch, each with its strongest action.

    A file that a shell command names must be hinted or exist (None: all exist).  Paths outside the
    root stay absolute."""
    seen: dict[str, str] = {}

    def add(path: str, action: str, must_exist: bool) -> None:
        key = relative_to(root, path) or (posixpath.normpath(path) if path.startswith("/") else None)
        if key and (not must_exist or key in hinted or existing is None or key in existing):
            seen[key] = max(seen.get(key, action), action, key=ACTIONS.index)

    for call in calls:
        for p in call.get("reads") or ():
            add(p, "read", False)
        for command in call.get("shell") or ():
            for p, action in shell_touches(command):
                add(p, action, True)
        for p in call.get("edits") or ():
            add(p, "edited", False)
    return list(seen.items())


#: Search tools with the flags that take a value.
SEARCH_TOOLS = {
    "rg": "-e -f -g -t -T -A -B -C -m -j -M --glob --type --max-count --context".split(),
    "grep": "-e -f -A -B -C -m --include --exclude --exclude-dir --max-count".split(),
    "ag": "-A -B -C -m -G --ignore".split(),
    "ack": "-A -B -C -m --type".split(),
    "fd": "-e -t -E -d --extension --type --exclude --max-depth".split(),
    "find": [],
}


def quoted_words(command: str) -> list[str]:
    """The words of a command with quotes and backslashes resolved; an open quote ends at the end."""
    out, word, quote, started, i = [], [], "", False, 0
    while i < len(command):
        c = command[i]
        if quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"' and i + 1 < len(command) and command[i + 1] in '"\\$`':
                i += 1
                word.append(command[i])
            else:
                word.append(c)
        elif c in "\"'":
            quote, started = c, True
        elif c == "\\" and i + 1 < len(command):
            i += 1
            word.append(command[i])
            started = True
        elif c.isspace():
            if started or word:
                out.append("".join(word))
            word, started = [], False
        else:
            word.append(c)
        i += 1
    if started or word:
        out.append("".join(word))
    return out


def search_pattern(command: str) -> str | None:
    """What a search command looks for: of rg, grep, ag, ack, git grep, fd or find; else None."""
    for segment in re.split(r"&&|\|\||[\n;|]", command):
        words = quoted_words(segment)
        words = words[_skip_wrappers(words) :]
        if words[:2] == ["git", "grep"]:
            words = ["grep", *words[2:]]
        name = words[0].rsplit("/", 1)[-1] if words else ""
        if name not in SEARCH_TOOLS:
            continue
        args = words[1:]
        if name == "find":
            named = [b for a, b in zip(args, args[1:]) if a in ("-name", "-iname", "-path", "-ipath", "-regex")]
            if named:
                return named[0]
            continue
        i = 0
        while i < len(args):
            a = args[i]
            if a in ("-e", "--regexp") and name != "fd" and i + 1 < len(args):
                return args[i + 1]
            if a == "--":
                return args[i + 1] if i + 1 < len(args) else None
            if a.startswith("-") and len(a) > 1:
                i += 2 if a in SEARCH_TOOLS[name] else 1
                continue
            return a
    return None


@pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("action", T.StringType())])))
def touches_udf(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: [{"path": p, "action": a} for p, a in shell_touches(c or "")])


@pandas_udf(T.StringType())
def search_pattern_udf(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: search_pattern(c) if c else None)


def command_touches(command: Column) -> Column:
    return touches_udf(command)
