"""Text functions over columns: cutting sections, cleaning, chunking, reading model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..runtime import ship


def python(f, kind: str, *args: Column) -> Column:
    """A function of one row in Python, fed in Arrow batches."""
    ship()
    return F.udf(f, kind, useArrow=True)(*args)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def before(text: Column, pattern: str | Column) -> Column:
    """The text up to a pattern's first match."""
    return F.element_at(F.split(text, pattern, 2), 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value that is computed once and used as often as needed."""
    return F.element_at(F.transform(F.array(value), then), 1)


def first_found(text: Column, patterns, flags: str) -> Column:
    """The first pattern of a list that a text holds, with its flags; null if none. One pass over all of them
    comes first, as most texts hold none."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(text.rlike(f"{flags}{p}"), F.lit(f"{flags}{p}")).otherwise(out)
    return F.when(text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), out)


def cut_references(text: Column, headers=vocab.REFERENCE_HEADERS, run: int = 3) -> Column:
    """Without the reference section: cut before the first header pattern of the list that is found,
    else before the first `run` consecutive lines that look like references (O-X1)."""

    def by_lines(lines: Column) -> Column:
        flags = F.transform(lines, lambda x: x.rlike(f"(?U){vocab.REFERENCE_LINE}"))
        runs = flags
        for k in range(1, run):
            shifted = F.slice(flags, k + 1, F.greatest(F.size(flags), F.lit(1)))
            runs = F.zip_with(runs, shifted, lambda a, b: a & b)
        return let(
            F.array_position(runs, True),
            lambda at: F.when(at > 0, rstrip(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "\n"))),
        )

    # Only a text with such a line at all is cut into lines.
    may = text.rlike(f"(?mU){vocab.REFERENCE_LINE}")
    whole = F.when(may, F.coalesce(let(F.split(text, "\n", -1), by_lines), text)).otherwise(text)
    return let(first_found(text, headers, "(?iU)"), lambda p: F.when(p.isNotNull(), rstrip(before(text, p))).otherwise(whole))


def cut_markdown_references(text: Column, headers=vocab.MARKDOWN_REFERENCE_HEADERS) -> Column:
    """Cut before the first header of the list that is found; nothing is trimmed (O-X3)."""
    return let(first_found(text, headers, "(?imU)"), lambda p: F.when(p.isNotNull(), before(text, p)).otherwise(text))


def cut_paper_references(text: Column, rules=vocab.PAPER_REFERENCES) -> Column:
    """Apply the first rule of the list that is found, everywhere; then trim (O-X2)."""
    out = text
    for pattern, keep in reversed(rules):
        p = f"(?isU){pattern}"
        out = F.when(text.rlike(p), F.regexp_replace(text, p, keep.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(out)
    return strip(out)


def cut_introduction(text: Column, headers=vocab.INTRODUCTION_HEADERS, ends=vocab.INTRODUCTION_ENDS) -> Column:
    """Without the part from the introduction's header to the next section's; unchanged if either is
    missing. Both lists are tried in order (O-X4)."""

    def cut(h: Column) -> Column:
        head = before(text, h)
        return let(head, lambda head: let(F.substring(text, F.length(head) + 1, F.length(text)), lambda rest: joined(head, rest)))

    def joined(head: Column, rest: Column) -> Column:
        found = first_found(rest, ends, "(?iU)")
        tail = lambda e: F.substring(rest, F.length(before(rest, e)) + 1, F.length(rest))
        return let(found, lambda e: F.when(e.isNotNull(), F.concat(head, tail(e))).otherwise(text))

    return let(first_found(text, headers, "(?iU)"), lambda h: F.when(h.isNotNull(), cut(h)).otherwise(text))


def within(text: Column, pattern: str, group: int, change: Callable[[Column], Column]) -> Column:
    """Each match of a pattern replaced by what a change makes of one of its groups."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(change(hit), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def plain_math(text: Column) -> Column:
    """Text between dollar signs without them, digits put together."""

    def tidy(hit: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(hit, r"(?U)(\d)\s+\.\s+(\d)", "$1.$2"), r"(?U)(\d)\s+(\d)", "$1$2")

    out = within(text, r"(?U)\$\s*\(\s*([^)]+)\s*\)\s*\$", 1, tidy)
    return within(out, r"(?U)\$\s*([^$]+)\s*\$", 1, tidy)


def clean_latex(text: Column, units=vocab.LATEX_UNITS) -> Column:
    """LaTeX as plain text (O-X5)."""
    out = F.regexp_replace(text, r"(?U)\s*~\s*", " ")
    out = F.regexp_replace(out, r"(?U)\\mathrm\s*\{([^}]*)\}", "$1")
    for pattern, unit in units:
        out = F.regexp_replace(out, f"(?iU){pattern}", unit)
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\\mu\s+", "μ"), r"\\mu([A-Z])", "μ$1")
    out = F.when(out.contains("$"), plain_math(out)).otherwise(out)  # most texts have none
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\\[a-zA-Z]+\s*", ""), r"[\$\{\}]", "")


def clean_whitespace(text: Column) -> Column:
    """One space at most, two line ends at most, no spaces around line ends (O-X6)."""
    out = F.regexp_replace(text, " +", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, " \n", "\n"), "\n ", "\n")
    return strip(out)


def preprocess(text: Column) -> Column:
    """References cut, LaTeX and white space cleaned; blank texts as they are (O-X7)."""
    return F.when(strip(text) == "", text).otherwise(clean_whitespace(clean_latex(cut_references(text))))


def split_text(text: str | None, size: int) -> list[str]:
    """Chunks of paragraphs up to a size; a longer paragraph is dealt out by sentences (O-X8). A
    paragraph counts two characters more for its gap, a sentence does not."""
    if text is None or len(text) <= size:
        return [] if text is None else [text]
    units: list[tuple[str, int, bool]] = []  # text, weight, starts a chunk
    for para in text.split("\n\n"):
        if len(para) > size:
            units += [(s, len(s), k == 0) for k, s in enumerate(para.replace(". ", ".\n").split("\n"))]
        else:
            units.append((para, len(para) + 2, False))
    chunks: list[list[str]] = [[]]
    used = 0
    for unit, weight, fresh in units:
        if chunks[-1] and (fresh or used + len(unit) > size):
            chunks.append([])
            used = 0
            if not fresh:
                weight = len(unit)
        elif not chunks[-1] and fresh:
            used = 0
        chunks[-1].append(unit)
        used += weight
    return ["\n\n".join(c) for c in chunks if c]


_SENTENCE = re.compile(r"[^.!?。！？]+[.!?。！？]+")


def sentences_of(text: str) -> list[str]:
    return _SENTENCE.findall(text) or [s.strip() for s in text.split("\n") if s.strip()]


def overlap_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of sentences up to a size, each led by the last sentences of the one before (O-X10)."""
    groups: list[list[str]] = []
    room = 0
    for s in sentences_of(text or ""):
        if not groups or room + len(s) > size:
            groups.append([])
            room = 0
        groups[-1].append(s)
        room += len(s)
    out = []
    for k, g in enumerate(groups):
        carried = groups[k - 1][-overlap:] if k else []
        out.append((f"[CONTEXT]: {' '.join(carried)}\n\n" if carried else "") + " ".join(g))
    return out


def split_column(text: Column, size: int) -> Column:
    return python(lambda t: split_text(t, size), "array<string>", text)


def overlap_column(text: Column, size: int, overlap: int = 3) -> Column:
    return python(lambda t: overlap_chunks(t, size, overlap), "array<string>", text)


def _close(text: str) -> str | None:
    """A cut-off list of objects, up to its last whole object."""
    depth, quoted, skip, last = 0, False, False, -1
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if ch == "}" and depth == 1:
                last = i
    return None if last < 0 else text[: last + 1] + "]"


def parse_records(answer: str | None) -> list[str]:
    """The JSON objects of a model's answer, as texts. Tried in turn: a fenced block, the first list,
    the whole; each as it is, without trailing commas, with missing commas, and closed after its last
    whole object. One object counts as a list of one; anything else is no record (O-X12)."""
    if not answer:
        return []
    text = answer.replace("<|begin_of_box|>", "").replace("<|end_of_box|>", "").strip()
    tries = [m[1].strip() for m in [re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.DOTALL)] if m]
    if "[" in text:
        tries.append(text[text.index("[") : text.rindex("]") + 1] if "]" in text else text[text.index("[") :])
        tries.append(text[text.index("[") :])
    tries.append(text)
    for raw in tries:
        no_trailing = re.sub(r",(\s*[}\]])", r"\1", raw)
        with_commas = re.sub(r"\}(\s*)\{", r"},\1{", no_trailing)
        for version in (raw, no_trailing, with_commas, _close(with_commas)):
            try:
                got = json.loads(version) if version else None
            except ValueError:
                continue
            if isinstance(got, dict):
                got = got.get("records", [got]) if isinstance(got.get("records"), list) else [got]
            if isinstance(got, list):
                return [json.dumps(x, ensure_ascii=False) for x in got if isinstance(x, dict)]
    return []


def records_column(answer: Column) -> Column:
    """parse_records. Spark calls a Python function for every row, whatever stands around it, so answers that
    are a plain list are sent to it as null and cost next to nothing there."""
    plain = F.from_json(answer, "array<string>")
    is_list = answer.rlike(r"(?s)\A\s*\[\s*\{.*\}\s*\]\s*\z") & F.try_parse_json(answer).isNotNull()
    hard = F.when(~F.coalesce(is_list, F.lit(False)), answer)
    return F.when(is_list, plain).otherwise(python(parse_records, "array<string>", hard))


def tool_call(answer: Column) -> Column:
    """The JSON object of a tool request in an answer, as text; null if none parses (O-X13)."""
    body = F.coalesce(
        F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")),
        F.nullif(F.regexp_extract(answer, r'(?s)(\{.*"tool(?:_name)?"\s*:.*\})', 1), F.lit("")),
    )
    return F.when(F.try_parse_json(body).isNotNull(), body)


def block_number(label: Column) -> Column:
    """The integer at the end of a block's label (O-X24)."""
    return F.nullif(F.regexp_extract(label, r"(\d+)$", 1), F.lit("")).cast("int")
