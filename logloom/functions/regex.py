"""Search patterns: RE2 syntax in, Java syntax out."""

import re

from pyspark.sql import Column, functions as F

# What RE2 means by a class or an assertion, outside and inside brackets. Its word
# borders and blanks are ASCII; Java's \b is not, and its \s has one blank more.
_BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NO_BORDER = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_OUTSIDE = {"b": _BORDER, "B": _NO_BORDER, "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "v": r"\x0B", "A": r"\A", "z": r"\z"}
_INSIDE = {"s": r"\t\n\f\r ", "S": r"\S\x0B", "v": r"\x0B"}
_SAME = set("dDwWaftnr")
REPEAT = re.compile(r"[*+?]|\{(?P<least>\d+)(?P<more>,(?P<most>\d*))?\}")
# Copies that repetitions, one inside the other, may make of a part.
_COPIES = 1000
_POSIX = {"alnum", "alpha", "ascii", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "word", "xdigit"}
_LETTERS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_GROUP = re.compile(r"\(\?(?:P?<(?P<name>\w+)>|(?P<on>[a-zA-Z]*)(?:-(?P<off>[a-zA-Z]+))?(?P<end>[:)]))")


class _Translator:
    """Walks a pattern once; the multi-line flag is known for every place, as groups nest."""

    def __init__(self, pattern: str):
        self.pattern, self.at, self.out = pattern, 0, []
        self.lines = [False]
        self.names: set[str] = set()
        # Whether nothing stands before this place that could be repeated.
        self.empty = True
        # The most copies made of a part inside each open group, and of the part just read.
        self.copies, self.last_copies = [1], 1

    def refuse(self, why: str):
        raise ValueError(f"invalid pattern {self.pattern!r}: {why}")

    def take(self, expression: str):
        found = re.compile(expression).match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def run(self) -> str:
        while self.at < len(self.pattern):
            c = self.pattern[self.at]
            if REPEAT.match(self.pattern, self.at) and self.empty:
                self.refuse("nothing to repeat")
            if c == "\\":
                quoted = self.take(r"(?s)\\Q(.*?)(?:\\E|\Z)") if self.pattern.startswith("\\Q", self.at) else None
                self.out.append(re.sub(r"([^\w\s])", r"\\\1", quoted[1]) if quoted else self.escape(_OUTSIDE))
                self.repeats()
            elif c == "[":
                self.bracket()
                self.repeats()
            elif c == "(":
                self.group()
            elif c == ")":
                if len(self.lines) == 1:
                    self.refuse("unexpected )")
                self.lines.pop()
                self.plain(c)
                self.last_copies = self.copies.pop()
                self.repeats()
            elif c == "^":
                self.plain(r"(?:\A|(?<=\n))" if self.lines[-1] else r"\A")
                self.empty = False
            elif c == "$":
                self.plain(r"(?=\n|\z)" if self.lines[-1] else r"\z")
                self.empty = False
            elif c == "|":
                self.plain(c)
                self.empty = True
            else:
                # A brace that begins no repetition is itself.
                self.plain("\\" + c if c in "{}" else c)
                self.repeats()
        if len(self.lines) > 1:
            self.refuse("missing )")
        return "".join(self.out)

    def plain(self, text: str):
        self.out.append(text)
        self.at += 1

    def repeats(self):
        """A repetition, perhaps a lazy one; a second one is refused, and so are too many copies, as RE2 does."""
        self.empty = False
        copies, self.last_copies = self.last_copies, 1
        found = REPEAT.match(self.pattern, self.at)
        if found and found["least"]:
            least, most = int(found["least"]), int(found["most"] or found["least"])
            if least > most or most * copies > _COPIES:
                self.refuse(f"repetition {found[0]}")
            copies *= max(most, 1)
        self.copies[-1] = max(self.copies[-1], copies)
        if not found:
            return
        self.out.append(found[0])
        self.at = found.end()
        if self.pattern.startswith("?", self.at):
            self.out.append("?")
            self.at += 1
        if REPEAT.match(self.pattern, self.at):
            self.refuse("a repetition of a repetition")

    def escape(self, meanings: dict) -> str:
        """One backslash sequence, outside (or inside) brackets."""
        octal = self.take(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})")
        if octal:
            return f"\\x{{{int(octal[1], 8):x}}}"
        code = self.take(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))")
        if code:
            return f"\\x{{{code[1] or code[2]}}}"
        script = self.take(r"\\([pP])(?:\{(\^?)(\w+)\}|([A-Z]))")
        if script:
            negative = (script[1] == "P") != (script[2] == "^")
            name = script[3] or script[4]
            return f"\\{'P' if negative else 'p'}{{{'Is' if len(name) > 2 else ''}{name}}}"
        if self.at + 1 >= len(self.pattern):
            self.refuse("a backslash at the end")
        c = self.pattern[self.at + 1]
        if not (c in meanings or c in _SAME or (c.isascii() and not c.isalnum())):
            self.refuse(f"\\{c}")
        self.at += 2
        return meanings.get(c, "\\" + c)

    def class_char(self) -> tuple[int, str]:
        """One character inside brackets: its code, and how it is spelled."""
        c = self.pattern[self.at]
        if c != "\\":
            self.at += 1
            return ord(c), "\\" + c if c in "[]&^-" else c
        text = self.escape(_INSIDE)
        code = re.fullmatch(r"\\x\{([0-9A-Fa-f]+)\}|\\(\W)|\\([afnrt])|\\x0B", text)
        if not code:
            self.refuse(f"{text} in a range")
        return int(code[1], 16) if code[1] else ord(code[2]) if code[2] else _LETTERS[code[3] or "v"], text

    def bracket(self):
        start = self.take(r"\[\^?")
        parts, first = [start[0]], True
        while True:
            if self.at >= len(self.pattern):
                self.refuse("missing ]")
            posix = self.take(r"\[:(\^?)(\w*):\]")
            if posix:
                if posix[2] not in _POSIX:
                    self.refuse(f"class {posix[0]}")
                java = {"word": r"\w", "xdigit": r"\p{XDigit}", "ascii": r"\p{ASCII}"}.get(posix[2], r"\p{" + posix[2].capitalize() + "}")
                parts.append(java.replace("\\w", "\\W").replace("\\p", "\\P") if posix[1] else java)
            elif self.pattern[self.at] == "]" and not first:
                self.at += 1
                break
            elif re.compile(r"\\[dDwWsSpP]").match(self.pattern, self.at):
                parts.append(self.escape(_INSIDE))
            else:
                low, text = self.class_char()
                parts.append(text)
                if re.compile(r"-[^\]]").match(self.pattern, self.at):
                    self.at += 1
                    high, text = self.class_char()
                    if high < low:
                        self.refuse("a range from high to low")
                    parts.append("-" + text)
            first = False
        self.out.append("".join(parts) + "]")

    def group(self):
        if not self.pattern.startswith("(?", self.at):
            self.lines.append(self.lines[-1])
            self.begin()
            self.plain("(")
            return
        found = _GROUP.match(self.pattern, self.at)
        if not found:
            self.refuse("a kind of group that is not known")
        self.at = found.end()
        if found["name"]:
            if found["name"] in self.names:
                self.refuse(f"a second group {found['name']}")
            self.lines.append(self.lines[-1])
            self.begin()
            # Nothing refers to a group by name, and Java's names have no underscore: they are numbered.
            self.names.add(found["name"])
            self.out.append(f"(?<g{len(self.names)}>")
            return
        on, off = found["on"] or "", found["off"] or ""
        unknown = set(on + off) - set("ims")
        if unknown:
            self.refuse(f"flag {min(unknown)}")
        lines = "m" in on or (self.lines[-1] and "m" not in off)
        kept = "".join(f for f in on if f != "m"), "".join(f for f in off if f != "m")
        flags = kept[0] + (f"-{kept[1]}" if kept[1] else "")
        if found["end"] == ")":
            self.lines[-1] = lines
            self.out.append(f"(?{flags})" if flags else "")
        else:
            self.lines.append(lines)
            self.begin()
            self.out.append(f"(?{flags}:")

    def begin(self):
        self.copies.append(1)
        self.empty = True


def to_java_regex(pattern: str) -> str:
    """Spell an RE2 pattern so that Java's engine finds the same matches.

    Borders, blanks and line anchors get RE2's meaning; what RE2 refuses is refused
    here too, and so is its ungreedy flag, which Java lacks.
    """
    return _Translator(pattern).run()


def search_regex(pattern: str) -> str:
    """The pattern as searched for: any case, Unicode folding, Unix line ends."""
    return "(?idu)" + to_java_regex(pattern)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(search_regex(pattern))


def highlight(text: Column, pattern: str, before: str = ">>", after: str = "<<") -> Column:
    """Put ``before`` and ``after`` around every match, in any case."""
    if not pattern:
        return text
    quoted = [m.replace("\\", "\\\\").replace("$", "\\$") for m in (before, after)]
    return F.regexp_replace(
        text, F.lit(f"(?idu)({to_java_regex(pattern)})"), F.lit(f"{quoted[0]}$1{quoted[1]}")
    )
