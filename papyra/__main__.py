"""python -m papyra VERB FILE ...: info, pages, check, extract, find, split, merge, rotate, render, images."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .functions import images, organize, raster, reading
from .functions.document import Document
from .functions.layout import banner
from .functions.structure import text_of


def info(d: Document) -> dict:
    own = d.get(d.trailer.get("Info")) if "Info" in d.trailer else None
    named = {k.lower(): text_of(d.field(own, k)) for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")}
    return {"version": d.version, "recovery": d.recovery, "pages": len(d.pages()), "objects": len(d.entries), "revisions": len(d.revisions), "encrypted": "Encrypt" in d.trailer} | named


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="papyra", description=__doc__)
    p.add_argument("verb", choices=["info", "pages", "check", "extract", "find", "split", "merge", "rotate", "render", "images"])
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--out", default="out.pdf")
    p.add_argument("--page", type=int, default=0, help="from 0")
    p.add_argument("--needle", default="")
    p.add_argument("--every", type=int, default=1)
    p.add_argument("--by", type=int, default=90)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--password", default="")
    a = p.parse_args(argv)
    docs = [Document(Path(f).read_bytes(), a.password.encode()) for f in a.files]
    d, out = docs[0], Path(a.out)
    if a.verb == "info":
        print(json.dumps(info(d)))
    elif a.verb == "pages":
        for i, page in enumerate(d.pages()):
            media, crop, turn = d.boxes(page)
            print(json.dumps({"page": i, "media": media, "crop": crop, "rotation": turn, "objects": reading.object_counts(d, page)}))
    elif a.verb == "check":
        for note in [banner(d), *d.notes]:
            if note:
                print(note)
        return 0 if d.recovery == "Clean" else 1
    elif a.verb == "extract":
        structure = reading.structure_order(d)
        print("\f".join(reading.page_text(d, page, True, structure) for page in d.pages()))
    elif a.verb == "find":
        for i, page in enumerate(d.pages()):
            for start, end in reading.find(reading.page_text(d, page), a.needle):
                print(i, start, end)
    elif a.verb == "split":
        for i, part in enumerate(organize.split_every(d, a.every)):
            out.with_name(f"{out.stem}-{i}.pdf").write_bytes(part)
    elif a.verb == "merge":
        out.write_bytes(organize.merge(docs))
    elif a.verb == "rotate":
        out.write_bytes(organize.rotate(d, a.page, a.by))
    elif a.verb == "render":
        out.write_bytes(images.png(raster.render(d, d.pages()[a.page], a.scale)))
    else:
        for name, pixels in images.page_images(d, d.pages()[a.page]):
            if pixels is not None:
                out.with_name(f"{out.stem}-{name}.png").write_bytes(images.png(pixels))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
