"""Text of a page: reading order, joining of runs, finding, lines and counts of page objects."""

from __future__ import annotations

from .cos import Ref
from .document import Document
from .interp import Interpreter, Mark, text_marks

DEPTH = 64


def structure_order(doc: Document) -> dict[int, list[int]]:
    """Page object number to its marked-content ids in the order of the structure tree; cycles are cut."""
    top = doc.get(doc.trailer.get("Root"))
    root = top.get("StructTreeRoot") if isinstance(top, dict) else None
    out: dict[int, list[int]] = {}
    seen: set[int] = set()

    def walk(v, page: int | None, depth: int) -> None:
        if isinstance(v, Ref):
            if v.num in seen or depth > DEPTH:
                return
            seen.add(v.num)
            v = doc.get(v)
        if isinstance(v, int) and not isinstance(v, bool):
            if page is not None:
                out.setdefault(page, []).append(v)
        elif isinstance(v, list):
            for x in v:
                walk(x, page, depth)
        elif isinstance(v, dict):
            pg = v.get("Pg")
            page = pg.num if isinstance(pg, Ref) else page
            if v.get("Type") == "MCR":
                walk(doc.field(v, "MCID"), page, depth)
            elif "K" in v:
                walk(v["K"], page, depth + 1)

    walk(root, None, 0)
    return out


def _gaps(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """(width, middle) of what the spans leave free between them."""
    out, end = [], None
    for a, b in sorted(spans):
        if end is not None and a > end:
            out.append((a - end, (a + end) / 2))
        end = b if end is None else max(end, b)
    return out


def by_cuts(marks: list[Mark]) -> list[Mark]:
    """Runs by columns, then bands: the widest gutter of over 1.5 sizes, else the widest band of over 0.6,
    else lines from the largest run on."""
    done: list[Mark] = []
    todo = [marks]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            done += part
            continue
        size = max(m.size for m in part)
        gutter = max(_gaps([(min(m.line[0], m.line[2]), max(m.line[0], m.line[2])) for m in part]), default=(0, 0))
        if gutter[0] > 1.5 * size:
            left = [m for m in part if m.line[0] < gutter[1]]
            todo += [[m for m in part if m.line[0] >= gutter[1]], left]
            continue
        band = max(_gaps([(m.line[1] - 0.25 * m.size, m.line[1] + 0.75 * m.size) for m in part]), default=(0, 0))
        if band[0] > 0.6 * size:
            todo += [[m for m in part if m.line[1] < band[1]], [m for m in part if m.line[1] >= band[1]]]
            continue
        lines: list[list[Mark]] = []
        for m in sorted(part, key=lambda m: (-m.size, -m.line[1], m.line[0])):
            near = next((x for x in lines if abs(x[0].line[1] - m.line[1]) <= 0.55 * max(x[0].size, m.size)), None)
            near.append(m) if near else lines.append([m])
        for x in sorted(lines, key=lambda x: -x[0].line[1]):
            done += sorted(x, key=lambda m: m.line[0])
    return done


def reading_order(marks: list[Mark], mcids: list[int] | None = None) -> list[Mark]:
    """Tagged runs in structure order, then the others by cuts."""
    place = {m: i for i, m in reversed(list(enumerate(mcids or [])))}
    tagged = sorted((m for m in marks if m.mcid in place), key=lambda m: place[m.mcid])
    return tagged + by_cuts([m for m in marks if m.mcid not in place])


def joined(marks: list[Mark]) -> str:
    """Runs to text: a line break where the baseline moves or the text goes back, a space at a gap."""
    out: list[str] = []
    before = None
    for m in marks:
        if not m.text:
            continue
        if before is not None:
            size = max(before.size, m.size)
            if abs(m.line[1] - before.line[3]) > 0.55 * size or m.line[0] < before.line[0] - 0.5 * size:
                out.append("\n")
            elif m.line[0] - before.line[2] > 0.25 * size and not m.text[0].isspace() and not before.text[-1].isspace():
                out.append(" ")
        out.append(m.text)
        before = m
    return "".join(out)


def page_text(doc: Document, page: dict, ordered: bool = False, structure: dict[int, list[int]] | None = None) -> str:
    marks = text_marks(doc, page)
    return joined(reading_order(marks, (structure or {}).get(page.get("#num"))) if ordered else marks)


def find(text: str, needle: str) -> list[tuple[int, int]]:
    """(start, end) in bytes of UTF-8 of matches that don't overlap; case is folded character by character."""
    low = needle.lower()
    if not low:
        return []
    if text.isascii():
        folded, starts = text.lower(), None
    else:
        parts, starts, at = [], [], 0
        for c in text:
            x = c.lower()
            parts.append(x)
            starts += [at] * len(x)
            at += len(c.encode("utf-8", "replace"))
        folded = "".join(parts)
        starts.append(at)
    out, i = [], folded.find(low)
    while i >= 0:
        end = i + len(low)
        if starts is None:
            out.append((i, end))
        else:
            while end < len(folded) and starts[end] == starts[end - 1]:  # to the next character of the source
                end += 1
            out.append((starts[i], starts[end]))
        i = folded.find(low, end)
    return out


def page_lines(marks: list[Mark]) -> tuple[list[list[Mark]], list[Mark]]:
    """(lines, loose runs): a run joins the first line whose baseline is near; if sizes differ by over half
    of the larger, it is loose."""
    lines: list[list[Mark]] = []
    loose: list[Mark] = []
    for m in marks:
        near = next((x for x in lines if abs(x[0].box[1] - m.box[1]) <= 0.35 * max(m.size, x[0].size, 1.0)), None)
        if near is None:
            lines.append([m])
        elif abs(near[0].size - m.size) > 0.5 * max(near[0].size, m.size):
            loose.append(m)
        else:
            near.append(m)
    return lines, loose


def object_counts(doc: Document, page: dict) -> dict[str, int]:
    """Page objects by kind: line, image, shading, form, path, loose-run."""
    marks = Interpreter(doc, page).marks
    lines, loose = page_lines([m for m in marks if m.kind == "text"])
    out = {"line": len(lines), "loose-run": len(loose)}
    for m in marks:
        if m.kind != "text":
            kind = "image" if m.kind == "inline" else m.kind
            out[kind] = out.get(kind, 0) + 1
    return {k: n for k, n in out.items() if n}


def hit(marks: list[Mark], x: float, y: float) -> int | None:
    """The topmost mark whose box holds a point: the last drawn."""
    return next((i for i in reversed(range(len(marks))) if marks[i].box[0] <= x <= marks[i].box[2] and marks[i].box[1] <= y <= marks[i].box[3]), None)


def located(texts: list[str], hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(object, start in it, end in it) of hits in texts laid end to end, by the object a hit begins in."""
    from bisect import bisect_right

    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t.encode("utf-8", "replace")))
    out = []
    for a, b in hits:
        i = min(bisect_right(starts, a) - 1, len(texts) - 1)
        out.append((i, a - starts[i], b - starts[i]))
    return out


def resource_counts(doc: Document, page: dict) -> dict[str, int]:
    """Entries of a page's resources by kind; XObjects by subtype."""
    resources, out = doc.field(page, "Resources"), {}
    for kind, table in (resources if isinstance(resources, dict) else {}).items():
        table = doc.get(table) if isinstance(table, Ref) else table
        if kind == "XObject" and isinstance(table, dict):
            for v in table.values():
                v = doc.get(v) if isinstance(v, Ref) else v
                sub = str(v.dict.get("Subtype")) if hasattr(v, "dict") else "missing"
                out[sub] = out.get(sub, 0) + 1
        elif isinstance(table, dict):
            out[kind] = len(table)
    return out
