"""Renders neutral patterns for Java (Spark), RE2 (other SQL engines) and Python, and finds the
literals a match must hold."""

from __future__ import annotations

import re
import warnings

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import re._constants as _c
    import re._parser as _parser

#: Unicode white space and the byte-order mark, as a class body.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: Extended_Pictographic, Unicode 17.
PICTOGRAPHS = """
a9 ae 203c 2049 2122 2139 2194-2199 21a9-21aa 231a-231b 2328 23cf 23e9-23f3 23f8-23fa
24c2 25aa-25ab 25b6 25c0 25fb-25fe 2600-2604 260e 2611 2614-2615 2618 261d 2620
2622-2623 2626 262a 262e-262f 2638-263a 2640 2642 2648-2653 265f-2660 2663 2665-2666
2668 267b 267e-267f 2692-2697 2699 269b-269c 26a0-26a1 26a7 26aa-26ab 26b0-26b1
26bd-26be 26c4-26c5 26c8 26ce-26cf 26d1 26d3-26d4 26e9-26ea 26f0-26f5 26f7-26fa 26fd
2702 2705 2708-270d 270f 2712 2714 2716 271d 2721 2728 2733-2734 2744 2747 274c 274e
2753-2755 2757 2763-2764 2795-2797 27a1 27b0 27bf 2934-2935 2b05-2b07 2b1b-2b1c 2b50
2b55 3030 303d 3297 3299 1f004 1f02c-1f02f 1f094-1f09f 1f0af-1f0b0 1f0c0 1f0cf-1f0d0
1f0f6-1f0ff 1f170-1f171 1f17e-1f17f 1f18e 1f191-1f19a 1f1ae-1f1e5 1f201-1f20f 1f21a
1f22f 1f232-1f23a 1f23c-1f23f 1f249-1f25f 1f266-1f321 1f324-1f393 1f396-1f397
1f399-1f39b 1f39e-1f3f0 1f3f3-1f3f5 1f3f7-1f3fa 1f400-1f4fd 1f4ff-1f53d 1f549-1f54e
1f550-1f567 1f56f-1f570 1f573-1f57a 1f587 1f58a-1f58d 1f590 1f595-1f596 1f5a4-1f5a5
1f5a8 1f5b1-1f5b2 1f5bc 1f5c2-1f5c4 1f5d1-1f5d3 1f5dc-1f5de 1f5e1 1f5e3 1f5e8 1f5ef
1f5f3 1f5fa-1f64f 1f680-1f6c5 1f6cb-1f6d2 1f6d5-1f6e5 1f6e9 1f6eb-1f6f0 1f6f3-1f6ff
1f7da-1f7ff 1f80c-1f80f 1f848-1f84f 1f85a-1f85f 1f888-1f88f 1f8ae-1f8af 1f8bc-1f8bf
1f8c2-1f8cf 1f8d9-1f8ff 1f90c-1f93a 1f93c-1f945 1f947-1f9ff 1fa58-1fa5f 1fa6e-1faff
1fc00-1fffd
"""  # fmt: skip


def _pict() -> str:
    return "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in PICTOGRAPHS.split())


LINE_ENDS = r"\n\r\x{2028}\x{2029}"
_TOKEN = re.compile(r"\\p\{Pict\}|\\.|\[\^?\]?|\]|\(\?[:!=]|[\s\S]")


def _rendered(regex: str, flags: str, boundary, begin: str, end: str) -> str:
    """Walk the pattern once; inside a class ``\\s`` is its body, outside a class of its own."""
    out, inside, at = [], False, 0
    while at < len(regex):
        t = _TOKEN.match(regex, at)[0]
        at += len(t)
        if t == r"\p{Pict}":
            out.append(f"[{_pict()}]")
        elif t == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif t == r"\b" and not inside:
            rest = regex[at:]
            leading = bool(re.match(r"[A-Za-z0-9_]|\\[wd]|\((?!\?!)", rest))
            out.append(boundary(leading))
        elif not inside and t.startswith("[") and len(t) < 4:
            inside = True
            out.append(t)
        elif inside and t == "]":
            inside = False
            out.append(t)
        elif t == "^" and not inside:
            out.append(begin if "m" in flags else r"\A")
        elif t == "$" and not inside:
            out.append(end if "m" in flags else r"\z")
        else:
            out.append(t)
    return ("(?i)" if "i" in flags else "") + "".join(out)


def java(regex: str, flags: str = "") -> str:
    """``\\b`` stands before or after a word character in every pattern, so one look-around is enough;
    the test after the literal costs less than one before every character would."""

    def boundary(leading: bool) -> str:
        return "(?<![A-Za-z0-9_])" if leading else "(?![A-Za-z0-9_])"

    return _rendered(regex, flags, boundary, f"(?<![^{LINE_ENDS}])", f"(?![^{LINE_ENDS}])")


def re2(regex: str, flags: str = "") -> str:
    """For engines without look-around: a trailing negative look-ahead is left off, and line ends are
    U+000A alone."""
    cut = re.sub(r"\(\?!.*\)$", "", regex)
    return ("(?m)" if "m" in flags else "") + _rendered(cut, flags, lambda leading: r"\b", "^", "$")


def python(regex: str, flags: str = "") -> re.Pattern:
    def unicode(x: str) -> str:
        return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), x)

    text = unicode(java(regex, flags)).replace(r"\z", r"\Z")
    return re.compile(text.removeprefix("(?i)"), re.ASCII | (re.IGNORECASE if "i" in flags else 0))


def _needed(parts, fold: bool) -> set[str] | None:
    """A set of strings of which every match holds at least one, or None. The choice with the
    longest shortest string wins, then the smaller set."""
    options: list[set[str]] = []
    literal = ""

    def close():
        nonlocal literal
        if literal:
            options.append({literal})
        literal = ""

    for op, arg in parts:
        if op is _c.LITERAL:
            literal += chr(arg)
            continue
        close()
        if op is _c.SUBPATTERN:
            options.append(_needed(arg[-1], fold) or set())
        elif op is _c.BRANCH:
            sets = [_needed(b, fold) for b in arg[1]]
            options.append(set().union(*sets) if all(sets) else set())
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            options.append(_needed(arg[2], fold) or set())
    close()
    options = [o for o in options if o]
    return max(options, key=lambda o: (min(min(len(x) for x in o), 4), -len(o), min(len(x) for x in o)), default=None)


def required(regex: str, flags: str = "") -> list[str] | None:
    """Lower-cased literals (all, where the pattern ignores case) of which each match holds one;
    None where there are no such literals. Alternatives that share a stem are drawn together."""
    text = re.sub(r"\\p\{Pict\}", "[\u00a9\u00ae]", regex)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = _needed(_parser.parse(text), "i" in flags)
    if not found:
        return None
    found = {x.lower() for x in found}
    return sorted(x for x in found if not any(y != x and y in x for y in found))
