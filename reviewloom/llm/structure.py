"""A pushdown parser for the mark-up of model answers: fences, values, quotations, brackets, emphasis, tags, lists and tables."""

from __future__ import annotations

import json

import regex

_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "«": "»", "<": ">"}
_OPENED_BY = {close: opener for opener, close in _PAIRS.items()}
_QUOTES = frozenset("「『“«")
_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)(?:\s[^<>]*?)?(/?)>")
#: HTML elements that must be closed. Others, as <answer>, count where they begin a line in small letters; so <PHONE>,
#: <me@example.com> and List<String> don't.
_ELEMENTS = frozenset(
    "a abbr address article aside audio b bdi bdo blockquote button canvas caption cite code data details dfn dialog div dl em fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header i iframe ins kbd label legend main map mark math menu nav object ol output picture pre q s samp script section "
    "select small span strong style sub summary sup svg table template textarea time title u ul var video".split()
)
#: Elements without an end, or whose end may be left out.
_VOID = frozenset("area base body br col colgroup dd dt embed head hr html img input li link meta option optgroup p param rp rt source tbody td tfoot th thead tr track wbr".split())
_MARKUP = regex.compile(r"[`{}\[\]<>()（）【】「」『』《》“”«»|\n]|\*\*")
_TOKEN = regex.compile(r"```[^\n`]*|`|\*\*|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*?)?/?>|[{}\[\]()（）【】「」『』《》“”«»]|\n\s*\n|\n")
_VALUE = regex.compile(r'\{|\[\s*(?:["\[{]|$)')
_LIST_END = regex.compile(r"(?:^|\n)[ \t]*(?:[-*+•·]|\d{1,3}[.)、．])[ \t]*$")
_EMPTY_WORDS = {"", "null", "none", "nil", "undefined", "n/a", "na", "nan"}
_UNSEEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}\p{Zs}\s]+")
_FENCE_ENDS, _TAGS, _LETTER = regex.compile(r"^```[A-Za-z]*|```$"), regex.compile(r"</?[A-Za-z][\w-]*[^<>]*>"), regex.compile(r"[\p{L}\p{N}]")

#: What can't be open at the end of a whole text; a quotation or a bracket can, as writers forget to close them.
DECISIVE = ("fence", "object", "opener", "list", "table", "emphasis", "tag")


_VALUES = json.JSONDecoder(strict=False)


def _skip_value(s: str, at: int) -> int | None:
    """The end of the object or list that starts at ``at``; None if it is never closed.

    Whole JSON is passed by the library's parser; what it can't read goes through one pass with a stack.
    """
    try:
        return _VALUES.raw_decode(s, at)[1]
    except (ValueError, RecursionError):
        pass
    stack, quoted, k = [], False, at
    while k < len(s):
        c = s[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return k + 1
        k += 1
    return None


def _begins_value(s: str, at: int) -> bool:
    """Whether the brace or bracket looks like a value's: at the start of the text, of a line or of a fence, or after a colon."""
    k = at
    while k and s[k - 1] in " \t":
        k -= 1
    return (not k or s[k - 1] in "\n`:：") and bool(_VALUE.match(s, at))


def still_open(text: str) -> list[str]:
    """What is open at the end of ``text``, the outermost first: one pass over its marks with a stack.

    Kinds are ``fence``, ``object``, ``code``, ``emphasis``, ``tag``, ``quotation``, ``bracket``, and of the last line
    ``opener`` (it ends in an opening mark), ``list`` (a bullet or number without its item) and ``table`` (a row without
    its end). Inside a fence only values count. Inline code ends with its line, emphasis, quotations and brackets with
    their paragraph.
    """
    s = text.rstrip()
    if not _MARKUP.search(s):
        return []
    stack, fence, k = _Stack(), False, 0
    while m := _TOKEN.search(s, k):
        token, k = m[0], m.end()
        if token.startswith("```"):
            fence = not fence
            if fence:
                stack.push("fence", "```")
            else:
                stack.close("fence", "```")
        elif token in "{[" and _begins_value(s, m.start()):
            end = _skip_value(s, m.start())
            if end is None:
                return [*(kind for kind, _ in stack), "object"]
            k = end
        elif fence:
            continue
        elif token == "`":
            if stack.holds("code", token):
                stack.close("code", token)
            else:
                stack.push("code", token)
        elif stack and stack[-1][0] == "code":
            if token[0] == "\n":
                stack.close("code", "`")
        elif token == "**":
            inner, outer = s[k : k + 1], s[m.start() - 1 : m.start()]
            if stack.holds("emphasis", token):
                stack.close("emphasis", token)
            elif inner.strip() and not outer.isalnum():
                stack.push("emphasis", token)
        elif token[0] == "\n":
            if len(token) > 1:
                stack.end_paragraph()
        elif token[0] == "<":
            _tag(stack, s, m.start())
        elif token in _PAIRS:
            stack.push("quotation" if token in _QUOTES else "bracket", token)
        elif token in _OPENED_BY:
            stack.close("quotation" if _OPENED_BY[token] in _QUOTES else "bracket", _OPENED_BY[token])
    return [*(kind for kind, _ in stack), *_at_last_line(text, s, fence)]


class _Stack(list):
    """Opened marks as (kind, mark); knows how many of each are open, so that a closer of nothing costs nothing."""

    def __init__(self) -> None:
        super().__init__()
        self._open: dict[tuple[str, str], int] = {}

    def push(self, kind: str, mark: str) -> None:
        self.append((kind, mark))
        self._open[kind, mark] = self._open.get((kind, mark), 0) + 1

    def holds(self, kind: str, mark: str) -> bool:
        return self._open.get((kind, mark), 0) > 0

    def close(self, kind: str, mark: str) -> None:
        """Pop up to the latest opener of this kind; what was opened inside it is over as well."""
        while self.holds(kind, mark):
            top = self.pop()
            self._open[top] -= 1
            if top == (kind, mark):
                return

    def end_paragraph(self) -> None:
        kept = [x for x in self if x[0] in ("fence", "tag")]
        self.clear()
        self._open.clear()
        for x in kept:
            self.push(*x)


def _tag(stack: _Stack, s: str, at: int) -> None:
    m = _TAG.match(s, at)
    name = m[2].lower() if m else ""
    if not m or m[3] or name in _VOID:
        return
    if m[1]:
        stack.close("tag", name)
    elif name in _ELEMENTS or (m[2].islower() and not s[s.rfind("\n", 0, at) + 1 : at].strip()):
        stack.push("tag", name)


def _at_last_line(text: str, s: str, fence: bool) -> list[str]:
    if fence:
        return []
    if s[-1] in _PAIRS:
        return ["opener"]
    if "\n" in text.strip() and _LIST_END.search(text.rstrip(" ")):
        return ["list"]
    lines = s[-4000:].split("\n")[-2:]
    if len(lines) == 2 and all(x.lstrip().startswith("|") for x in lines) and lines[0].rstrip().endswith("|") and lines[0].count("|") > lines[1].count("|"):
        return ["table"]
    return []


def open_structure(text: str) -> str | None:
    """The outermost of ``DECISIVE`` that is open at the end of ``text``, else ``quotation`` or ``bracket``; None if nothing is."""
    found = still_open(text)
    return next((x for x in found if x in DECISIVE), next((x for x in found if x in ("quotation", "bracket")), None))


def _holds_nothing(value: object) -> bool:
    if isinstance(value, dict):
        return all(map(_holds_nothing, value.values()))
    if isinstance(value, list):
        return all(map(_holds_nothing, value))
    return value is None or (isinstance(value, str) and is_shell(value))


def is_shell(text: str | None) -> bool:
    """Whether the text holds nothing: null, blank, signs alone, a word for nothing, or mark-up around nothing."""
    if text is None:
        return True
    if len(text) > 24 and text[0].isalnum() and text[0] not in "nNuU":
        return False
    s = _UNSEEN.sub(" ", text).strip()
    s = _FENCE_ENDS.sub("", s).strip()
    s = _TAGS.sub("", s).strip()
    if s.strip("\"'“”‘’ `").lower() in _EMPTY_WORDS:
        return True
    if s[:1] in "{[":
        try:
            return _holds_nothing(json.loads(s))
        except (ValueError, RecursionError):
            pass
    return not _LETTER.search(s)
