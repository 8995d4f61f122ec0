"""Patterns with placeholders over the tokens of a text, whose brackets stay in balance."""

from __future__ import annotations

import re

#: A placeholder, and what counts as one token.
PLACEHOLDER = re.compile(r"__([A-Za-z][A-Za-z0-9_]*?)__(?![A-Za-z0-9_])")
_TOKEN = re.compile(r"""__[A-Za-z][A-Za-z0-9_]*?__(?![A-Za-z0-9_])|[^\W\d]\w*|\d[\w.]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\S""")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: What no placeholder holds outside of brackets.
_ENDS = {",", ";", *_CLOSE.values()}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Tokens with their places: names, numbers, quoted strings, and other characters by themselves."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


class Pattern:
    """A pattern and what takes the place of its matches.

    ``__name__`` matches one or more tokens with brackets in balance, without a
    comma or semicolon outside of them; as few as will do.  One that comes
    again must match the same tokens.  White space doesn't count.  A match
    doesn't begin in the middle of a name with dots.
    """

    def __init__(self, pattern: str, goal: str):
        self.parts = [(t, PLACEHOLDER.fullmatch(t)) for t, _, _ in tokens(pattern)]
        self.parts = [(m[1], True) if m else (t, False) for t, m in self.parts]
        if not self.parts or all(held for _, held in self.parts):
            raise ValueError("the pattern must hold something besides placeholders")
        missing = set(PLACEHOLDER.findall(goal)) - {t for t, held in self.parts if held}
        if missing:
            raise ValueError(f"the goal names placeholders that the pattern has not: {sorted(missing)}")
        self.goal = goal

    def rewrite(self, text: str) -> tuple[str, int]:
        """The text with its matches replaced, leftmost first and none within another, and how many there were."""
        found = tokens(text)
        words, partner, open_ = [t for t, _, _ in found], {}, []
        for i, t in enumerate(words):
            if t in _CLOSE:
                open_.append(i)
            elif open_ and t == _CLOSE[words[open_[-1]]]:
                partner[open_.pop()] = i
            elif t in _CLOSE.values():
                open_.clear()  # out of balance: what was open stays without an end
        places: dict[str, list[int]] = {}
        for i, t in enumerate(words):
            places.setdefault(t, []).append(i)
        first, held = self.parts[0]
        out, last, n, i = [], 0, 0, 0
        for start in range(len(words)) if held else places.get(first, []):
            if start < i or (start and words[start - 1] == "."):
                continue
            end, names = self._match(words, partner, start)
            if end is None:
                continue

            def held_text(m: re.Match, names=names) -> str:
                a, b = names[m[1]]
                return text[found[a][1] : found[b - 1][2]]

            out += [text[last : found[start][1]], PLACEHOLDER.sub(held_text, self.goal)]
            last, n, i = found[end - 1][2], n + 1, end
        return "".join([*out, text[last:]]), n

    def _match(self, words: list[str], partner: dict[int, int], start: int) -> tuple[int | None, dict]:
        """Where a match from a token on ends, and what its placeholders hold: the last choice that fails is made anew."""
        at, names, part = start, {}, 0
        choices: list[tuple[int, int, int, dict]] = []  # part, where it began, where it may end next, names before
        while True:
            ok = True
            if part == len(self.parts):
                return at, names
            t, held = self.parts[part]
            if not held:
                ok = at < len(words) and words[at] == t
                at += 1
            elif t in names:
                a, b = names[t]
                ok = words[at : at + b - a] == words[a:b]
                at += b - a
            else:
                choices.append((part, at, at, names))
                ok = False
            part += 1
            while not ok:
                if not choices:
                    return None, {}
                part, begin, end, before = choices.pop()
                if end < len(words) and words[end] not in _ENDS and (words[end] not in _CLOSE or end in partner):
                    end = partner.get(end, end) + 1
                    choices.append((part, begin, end, before))
                    at, names, ok = end, {**before, self.parts[part][0]: (begin, end)}, True
                    part += 1
