"""Model files in XMI: parsing and writing on the driver, for files of ordinary size.

Larger models come as many files; ``read_xmi`` reads each of them in a task of its own.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "{http://www.omg.org/XMI}id"
_TYPE = "{http://www.w3.org/2001/XMLSchema-instance}type"
OBJECTS = "id string, eclass string, attrs map<string,string>"
LINKS = "src string, dst string, ref string, pos long"


def parse(text: str, prefix: str = "") -> tuple[list[tuple], list[tuple]]:
    """Objects (id, class, attributes) and links (src, dst, ref, pos) of one document.

    An element's class is its xsi:type, else its tag; nested elements are contained, by the
    reference of their tag; attributes of the form ``#a #b``, or of paths ``//@ref.0/@ref.1`` from the
    root, refer to other objects. An element without an id is called by its number, after ``prefix``.
    """
    objects, links, count = [], [], 0
    at_path: dict[str, str] = {}
    paths: list[tuple] = []

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]

    def walk(e: ET.Element, parent: str | None, ref: str | None, pos: int, path: str) -> None:
        nonlocal count
        oid = e.get(_ID) or e.get("id") or f"{prefix}_{count}"
        count += 1
        at_path[path] = oid
        attrs = {}
        for k, v in e.attrib.items():
            if k in (_ID, _TYPE, "id"):
                continue
            targets = v.split()
            if targets and all(t.startswith("#") for t in targets):
                links.extend((oid, t[1:], local(k), i) for i, t in enumerate(targets))
            elif targets and all(t.startswith("/") for t in targets):
                paths.extend((oid, t, local(k), i, v) for i, t in enumerate(targets))
            else:
                attrs[local(k)] = v
        objects.append((oid, local(e.get(_TYPE) or e.tag), attrs))
        if parent is not None:
            links.append((oid, parent, "eContainer", None))
            links.append((parent, oid, ref, pos))
        seen: dict[str, int] = {}
        for i, c in enumerate(e):
            tag = local(c.tag)
            n = seen[tag] = seen.get(tag, -1) + 1
            walk(c, oid, tag, i, f"{path}/@{tag}.{n}")

    root = ET.fromstring(text)
    many = local(root.tag) == "XMI"
    for i, r in enumerate(list(root) if many else [root]):
        walk(r, None, None, 0, f"/{i}" if many else "/")
    for oid, target, ref, i, _ in paths:
        links.append((oid, at_path.get(target, target), ref, i))
    return objects, links


def read_xmi(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and links of all files that ``path`` matches, a file at a time."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

    def part(which: int):
        def run(frames) -> Iterator:
            import pandas as pd

            for f in frames:
                for text, file in zip(f["value"], f["file"], strict=True):
                    rows = parse(text, file.rsplit("/", 1)[-1])[which]
                    names = ["id", "eclass", "attrs"] if which == 0 else ["src", "dst", "ref", "pos"]
                    out = pd.DataFrame(rows, columns=names)
                    if which:
                        out["pos"] = out["pos"].astype("Int64")
                    yield out

        return run

    return files.mapInPandas(part(0), OBJECTS), files.mapInPandas(part(1), LINKS)


def write_xmi(objects: list[tuple], links: list[tuple]) -> str:
    """One document of the objects; containment nests, other links become ``#id`` attributes."""
    by = {o[0]: o for o in objects}
    parent = {s: d for s, d, r, _ in links if r == "eContainer"}
    children: dict[str, list] = {}
    refs: dict[str, dict[str, list]] = {}
    for s, d, r, p in sorted(links, key=lambda x: (x[0], x[2], x[3] or 0)):
        if r == "eContainer":
            continue
        if parent.get(d) == s:
            children.setdefault(s, []).append((r, d))
        else:
            refs.setdefault(s, {}).setdefault(r, []).append(f"#{d}")

    def element(tag: str, oid: str) -> str:
        _, kind, attrs = by[oid]
        text = "".join(f" {k}={quoteattr(v)}" for k, v in sorted((attrs or {}).items()))
        text += "".join(f" {r}={quoteattr(' '.join(t))}" for r, t in refs.get(oid, {}).items())
        inner = "".join(element(r, d) for r, d in children.get(oid, []))
        return f"<{tag} xmi:id={quoteattr(oid)} xsi:type={quoteattr(kind)}{text}>{inner}</{tag}>"

    roots = "".join(element(o[1], o[0]) for o in objects if o[0] not in parent)
    head = 'xmlns:xmi="http://www.omg.org/XMI" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    return f"<xmi:XMI {head}>{roots}</xmi:XMI>"
