"""Column functions on text: tokens, lines, query texts, errors, literals and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern of the lexical ranker, and the ten line breaks.
TOKENS = r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|\d+"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
BLANKS = (
    " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: Instructions before a query, and lengths kept of its parts.
FOR_FILES = "Instruct: Given a coding task and recent context, find the file that must be read or edited next\nQuery: "
FOR_FUNCTIONS = "Instruct: Given a coding task and recent context, find the function that must be edited\nQuery: "
LIMIT_1, LIMIT_2, REQUEST_2, LEAST_CONTEXT = 2400, 3200, 900, 400

#: Patterns that show an error by themselves, and words of which two are needed.
STRONG_ERRORS = [
    r"Traceback \(most recent call last\)",
    r'(?m)^\s*File "[^"]+", line \d+',
    r"(?m)^\s+at [\w$.<>\[\]/]+ ?\(.*:\d+(:\d+)?\)",
    r"(?m)^\s+at .+:\d+:\d+\s*$",
    r"(?m)^\s*(\w+\.)*[A-Z]\w*(Error|Exception)(: |:$|\()",
    r"(?m)^\s*(error|Error|ERROR)(\[E\d+\])?: ",
    r"(?m)^[^\s:]+:\d+(:\d+)?: (fatal )?error: ",
    r"(?m)^\s*(thread '.+' )?panicked at ",
    r"(?m)^panic: |\bpanic(ked|s)?\b",
    r"(?m)^(FAILED|FAIL)[: ]|\bFAILED\b",
    r"(?m)^E\s{3,}\S",
    r"\bAssertionError\b",
    r"Segmentation fault|core dumped|SIGSEGV",
    r"undefined reference to",
    r"(?m)^npm ERR!",
    r"(?m)^fatal: ",
    r"exit (code|status) [1-9]\d*\b",
    r"\bUncaught \w+",
    r"(?i)\bstack ?trace\b",
    r"\bTraceback\b",
    r"(?m)\b[A-Z][A-Za-z0-9]*(Error|Exception)(:|\(|\s+['\"]|\s*$)",
    r"\bError: \S",
    r"\bException(:|\s+in\s)",
]
WEAK_ERRORS = r"(?i)\b(error|errors|exception|crash(es|ed)?|fails?|failing|failed|broken|raises?)\b"


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), F.lower)


def strip(text: Column) -> Column:
    """Without white space at both ends, separators U+001C to U+001F included."""
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """Lines by all ten line breaks; a break at the end opens no line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stem(word: Column) -> Column:
    """-ies, -ing, -ed, -es or -s cut off where enough of the word (in bytes) is left; one suffix at most."""
    size = F.octet_length(word)
    out = F.when((size > 5) & word.endswith("ies"), F.substr(word, F.lit(1), F.length(word) - 3))
    for suffix in ("ing", "ed", "es", "s"):
        out = out.when((size > len(suffix) + 3) & word.endswith(suffix), F.substr(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def query_text(query: Column, context: Column, instruction: str = FOR_FILES) -> Column:
    """Instruction, task, and the newest end of the context."""
    q, c = strip(query), strip(context)
    room = F.greatest(F.lit(LEAST_CONTEXT), LIMIT_1 - F.least(F.length(q), F.lit(LIMIT_1 // 2)))
    kept = (F.lit(LIMIT_1) - F.least(room, F.length(c))).cast("int")
    both = F.concat(F.substr(q, F.lit(1), kept), F.lit("\nRecent context:\n"), F.right(c, room))
    return F.concat(F.lit(instruction), F.when(c == "", F.left(q, F.lit(LIMIT_1))).otherwise(both))


def split_context(context: Column) -> tuple[Column, Column]:
    """(earlier, last tool output): parted at the first line that marks the last output."""
    c = strip(context)
    framed = F.concat(F.lit("\n"), c)
    earlier, last = c, F.lit("")
    for mark in ("\nLast output:\n", "\nLast tool output:\n"):
        at = F.instr(framed, mark)
        earlier = F.when(at > 0, strip(F.substr(framed, F.lit(1), at - 1))).otherwise(earlier)
        last = F.when(at > 0, strip(F.substr(framed, at + len(mark)))).otherwise(last)
    return earlier, last


def query_text_2(query: Column, context: Column, instruction: str = FOR_FILES) -> Column:
    """Instruction, request, the end of the last tool output, then the newest earlier context."""
    q = F.left(strip(query), F.lit(REQUEST_2))
    earlier, last = split_context(context)
    room = F.lit(LIMIT_2) - F.length(q)
    share = F.least(F.length(last), F.greatest(F.lit(LEAST_CONTEXT), F.floor(room * 3 / 5).cast("int")))
    has_last = (last != "") & (room > 0)
    after = F.when(has_last, room - share).otherwise(room)
    return F.concat(
        F.lit(instruction),
        q,
        F.when(has_last, F.concat(F.lit("\nLast tool output:\n"), F.right(last, share))).otherwise(""),
        F.when((earlier != "") & (after > 100), F.concat(F.lit("\nEarlier context:\n"), F.right(earlier, after))).otherwise(""),
    )


def history_body(subject: Column, body: Column) -> Column:
    """A commit as a task: its subject, and the first line of its body that isn't blank, if short."""
    first = F.try_element_at(F.filter(F.transform(lines(F.coalesce(body, F.lit(""))), strip), lambda x: x != ""), F.lit(1))
    return F.concat(strip(subject), F.when(F.length(first) <= 160, F.concat(F.lit("\n"), first)).otherwise(""))


def history_query(subject: Column, body: Column) -> Column:
    return F.concat(F.lit(FOR_FILES), F.left(history_body(subject, body), F.lit(LIMIT_1)))


def _java(pattern: str) -> str:
    """The pattern with only the newline as a line end."""
    return pattern.replace("(?m)", "(?dm)")


def has_error(text: Column) -> Column:
    strong = F.lit(False)
    for p in STRONG_ERRORS:
        strong = strong | text.rlike(_java(p))
    weak = F.size(F.regexp_extract_all(text, F.lit(WEAK_ERRORS), F.lit(0))) >= 2
    return (text != "") & (strong | (weak & (strip(text).contains("\n") | text.contains("`"))))


def query_kind(query: Column, context: Column) -> Column:
    """error, conversational, issue or request."""
    q, c = strip(query), strip(context)
    count = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(q, "\n$", ""), "\n")))
    return (
        F.when(has_error(q) | has_error(c), "error")
        .when((c != "") & (F.length(q) <= 300) & (count <= 3), "conversational")
        .when((count > 1) | (F.length(q) >= 200), "issue")
        .otherwise("request")
    )


#: Exact fragments of a query: quoted text, identifiers, file:line; and words that are none.
QUOTED = "[\"'`]([^\"'`\n]{8,120})[\"'`]"
IDENTIFIER = r"\b([A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Za-z0-9_./-]+\.[A-Za-z0-9]+:\d+)\b"
#: The same with ASCII words only, whatever letters of other scripts stand beside them.
ASCII_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
ASCII_IDENTIFIER = IDENTIFIER.replace(r"\b", ASCII_EDGE)
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
NO_LITERALS = "TODO HTTP JSON".split()
MOST_LITERALS = 12


def query_literals(text: Column, identifier: str = IDENTIFIER) -> Column:
    """Exact fragments worth looking up, in order of appearance, then phrases of error lines; 12 at most."""
    trim = lambda x: F.btrim(x, F.lit(SPACES))
    whole = F.regexp_extract_all(text, F.lit(f"{QUOTED}|{identifier}"), F.lit(0))
    bare = F.transform(whole, lambda x: trim(F.when(x.rlike("^[\"'`]"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(F.split_part(x, F.lit(":"), F.lit(1)))))
    found = F.filter(bare, lambda x: (F.octet_length(x) >= 4) & ~x.isin(NO_LITERALS))
    errors = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x.contains(":") & (F.split_part(x, F.lit(":"), F.lit(1)).rlike("panicked|Error|Exception|^(?i:panic)\\z")))
    phrase = F.transform(errors, lambda x: trim(F.element_at(F.split(trim(F.substr(x, F.instr(x, ":") + 1)), "[.\n'\"`]"), 1)))
    phrases = F.filter(phrase, lambda x: (F.octet_length(x) >= 12) & (F.octet_length(x) <= 120))
    return F.slice(F.array_distinct(F.concat(found, phrases)), 1, MOST_LITERALS)


def config_doc(path: Column, text: Column, keep: int = 15) -> Column:
    """The text to embed for a configuration file: its first lines that are neither blank nor comments."""
    body = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    return F.left(F.concat(F.lit("file: "), path, F.lit("\n"), F.array_join(F.slice(body, 1, keep), "\n")), F.lit(1500))


def component_doc(path: Column, text: Column) -> Column:
    """The text to embed for a component file: its body with white space levelled."""
    return F.left(F.concat(F.lit("file: "), path, F.lit("\n"), F.btrim(F.regexp_replace(text, r"\s+", " "))), F.lit(1500))


def search_intent(pattern: Column) -> Column:
    """A search pattern as words: escapes, classes and wildcards become blanks; null below three letters."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\\[a-zA-Z]", " "), r"[^A-Za-z0-9_./-]+", " ")
    plain = F.btrim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(F.length(F.regexp_replace(plain, "[^A-Za-z0-9]", "")) >= 3, plain)


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and -_.~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def model_name(fingerprint: Column) -> Column:
    """A fingerprint's readable part: up to the first part of twelve or more hex digits."""
    return F.regexp_replace(fingerprint, "-[0-9a-f]{12,}.*$", "")


#: The terms of the identifier-grep baseline.
GREP_TERMS = [r"[A-Za-z_][\w]*\.[A-Za-z_][\w.]*", r"\b[a-z]+_[a-z_0-9]+\b", r"\b[a-z]+[A-Z]\w+\b", r"\b[A-Z][a-z]+[A-Z]\w+\b", r"\b[A-Za-z]{7,}\b"]


def grep_terms(text: Column, most: int = 12) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)) for p in GREP_TERMS])  # letters of any script make words
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 4)), 1, most)
