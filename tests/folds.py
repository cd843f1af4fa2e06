"""Sequential state machines in plain Python, written as transition tables.

The operators compute the same states inside slices; the tests compare the two
on random files and several slice sizes.  A line's class comes from plain
string tests; a table maps ``(state, class)`` to the next state and whether the
line opens a block.
"""


def lead(text):
    """Blanks a line begins with, and the rest."""
    rest = text.lstrip(" \t")
    return text[:len(text) - len(rest)], rest


def is_marker(text):
    _, rest = lead(text)
    if not rest.startswith("#"):
        return False
    rest = rest[1:]
    return rest.startswith("--") or (rest[:1] in (" ", "\t") and rest[1:].startswith("--"))


def marker_text(text):
    rest = lead(text)[1][1:].lstrip(" \t").lstrip("-")
    return rest.lstrip(" \t").split("\n")[0]


# W-1.  State: in a documentation run or not.  Class: M marker, A comment with the indent of the
# comment before it, both: B; anything else O.
DOC_TABLE = {
    ("out", "O"): "out", ("out", "A"): "out", ("out", "M"): "run", ("out", "B"): "run",
    ("run", "O"): "out", ("run", "A"): "run", ("run", "M"): "out", ("run", "B"): "run",
}


def doc_class(before, text):
    indent, rest = lead(text)
    adjacent = rest.startswith("#") and before is not None and lead(before)[0] == indent and lead(before)[1].startswith("#")
    if is_marker(text):
        return "B" if adjacent else "M"
    return "A" if adjacent else "O"


def doc_blocks(texts):
    """``[(kind, meta, offset, length, line)]``."""
    state, out, offset = "out", [], 0
    for number, text in enumerate(texts):
        after = DOC_TABLE[state, doc_class(texts[number - 1] if number else None, text)]
        if not out or after != state:
            out.append(["doc" if after == "run" else "text", marker_text(text) if after == "run" else None, offset, 0, number])
        out[-1][3] += len(text)
        offset += len(text)
        state = after
    return [tuple(b) for b in out]


# W-3.  Class: M marker (any blanks before the dashes), C comment, X code; the state is the kind.
TYPED_TABLE = {
    (state, line): after
    for state in (None, "text", "comment", "code")
    for line, after in (("M", ("text", True)), ("X", ("code", state != "code")),
                        ("C", (state if state in ("text", "comment") else "comment", state not in ("text", "comment"))))
}


def typed_blocks(texts):
    """``[(kind, line, n_lines)]``."""
    state, out = None, []
    for number, text in enumerate(texts):
        rest = lead(text)[1]
        line = "X" if not rest.startswith("#") else "M" if rest[1:].lstrip().startswith("--") else "C"
        state, opens = TYPED_TABLE[state, line]
        if opens:
            out.append([state, number, 0])
        out[-1][2] += 1
    return [tuple(b) for b in out]


def prose_blocks(texts, rule_of):
    """W-5: ``[(kind, line, n_lines)]``; ``rule_of`` names the rule of a line, ``fence`` or None."""
    state, out = "start", []
    for number, text in enumerate(texts):
        rule = rule_of(text)
        if state == "code":
            kind, opens, after = "Code", False, "start" if rule == "fence" else "code"
        elif rule == "fence":
            kind, opens, after = "Code", True, "code"
        elif rule is not None:
            kind, opens, after = rule, True, "start"
        else:
            kind, opens, after = "Text", state != "text", "text"
        if opens:
            out.append([kind, number, 0])
        out[-1][2] += 1
        state = after
    return [tuple(b) for b in out]
