"""What a regular expression needs: plain substrings of which every match holds at least one."""

from __future__ import annotations


def substring_reader():
    """A function from a pattern to its required substrings (lower case), empty where nothing plain is required.

    Alternatives give one substring each; of a sequence the part with the longest shortest substring is taken. Whatever the
    reader does not know (classes, look-around, references, flags) requires nothing, so the result is always safe.
    (The function is nested, so that Spark ships it by value.)
    """

    def required(pattern):
        try:
            found, end = alternatives(pattern, 0)
        except (IndexError, ValueError):
            return []
        return sorted(found) if found and end == len(pattern) else []

    def alternatives(p, at):
        """Required substrings of branches up to an unmatched ) or the end; None where some branch requires nothing."""
        branches = []
        while True:
            best, at = sequence(p, at)
            branches.append(best)
            if at >= len(p) or p[at] == ")":
                return (None if None in branches else frozenset().union(*branches)), at
            at += 1  # the |

    def better(a, b):
        size = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
        return a if size(a) >= size(b) else b

    def sequence(p, at):
        best, run = None, ""
        while at < len(p) and p[at] not in "|)":
            char, group = None, None
            if p[at] == "(":
                group, at = bracket(p, at)
            elif p[at] == "[":
                at = past_class(p, at)
            elif p[at] == "\\":
                char, at = (p[at + 1], at + 2) if not p[at + 1].isalnum() else (None, past_escape(p, at))
            elif p[at] in ".^$":
                at += 1
            elif p[at] in "*+?{":
                raise ValueError("a quantifier without an atom")
            else:
                char, at = p[at], at + 1
            least, most, at = quantifier(p, at)
            if char is not None and (least, most) == (1, 1):
                run += char.lower()
                continue
            if char is not None and least:
                run += char.lower()
            best = better(best, frozenset([run]) if run else None)
            run = char.lower() if char is not None and least and most == least else ""
            if group and least:
                best = better(best, group)
        return better(best, frozenset([run]) if run else None), at

    def bracket(p, at):
        """A group's required substrings; what looks around requires nothing, and flags cannot be read."""
        start = at + 1
        if p.startswith("(?:", at):
            start = at + 3
        elif p.startswith("(?<", at) and p[at + 3] not in "=!":
            start = p.index(">", at) + 1
        elif p[at + 1] == "?":
            if p[at + 2] not in "=!<":
                raise ValueError("flags change what they are before")
            return None, past_group(p, at)
        found, at = alternatives(p, start)
        if p[at] != ")":
            raise ValueError("a group without its end")
        return found, at + 1

    def past_group(p, at):
        depth = 0
        while True:
            if p[at] == "[":
                at = past_class(p, at)
                continue
            depth += (p[at] == "(") - (p[at] == ")")
            at += 2 if p[at] == "\\" else 1
            if not depth:
                return at

    def past_class(p, at):
        at += 1
        at += p[at] == "^"
        at += p[at] == "]"
        while p[at] != "]":
            at = past_class(p, at) if p[at] == "[" else at + (2 if p[at] == "\\" else 1)
        return at + 1

    def past_escape(p, at):
        """Past an escape with a letter or digit; those that take more of the pattern with them cannot be read."""
        if p[at + 1] not in "dDsSwWbBnrtfAzZ123456789":
            raise ValueError("an escape that is not known")
        return at + 2

    def quantifier(p, at):
        least, most = 1, 1
        if at < len(p) and p[at] in "*+?":
            least, most, at = int(p[at] == "+"), (1 if p[at] == "?" else -1), at + 1
        elif at < len(p) and p[at] == "{":
            end = p.index("}", at)
            low, comma, high = p[at + 1 : end].partition(",")
            least, most, at = int(low), (int(high) if high else -1) if comma else int(low), end + 1
        else:
            return least, most, at
        if at < len(p) and p[at] in "?+":
            at += 1
        return least, most, at

    return required
