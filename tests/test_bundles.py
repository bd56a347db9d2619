"""Pasted bundles against written cases and plain Python."""

import base64
import hashlib
import json
import random
import re

from tessera.operators import bundles

MARK = re.compile(r"!\[([^\]]*)\]\(clipboard-image://([A-Za-z0-9._-]+)\)")


def image(name, data=b"x", **more):
    return {"id": name, "data": base64.b64encode(data).decode(), "mimeType": "image/png", "filename": f"{name}.png", "alt": "", **more}


def blocks(spark, *docs):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc int, bundle string")
    return [r.asDict() for r in bundles.bundle_blocks(df, "doc", "bundle").orderBy("doc", "block").collect()]


def test_outline_is_handed_on(spark):
    text = "# A\nfirst\n![one](clipboard-image://p1)\nsecond\n## B\nthird\n![](clipboard-image://p2)\n# C\n![x](clipboard-image://gone)last"
    got = blocks(spark, {"version": 1, "content": text, "images": [image("p1"), image("p2", description="a map"), image("p3", b"y", alt="left over")]})
    assert [(r["kind"], r["content"].split("](")[0], r["path"]) for r in got] == [
        ("HEADING", "# A", ["A"]), ("PARAGRAPH", "first", ["A"]), ("IMAGE", "![one", ["A"]), ("PARAGRAPH", "second", ["A"]), ("HEADING", "## B", ["A", "B"]), ("PARAGRAPH", "third", ["B"]),
        ("IMAGE", "a map\n\n![p2.png", ["A", "B"]), ("HEADING", "# C", ["C"]), ("PARAGRAPH", "last", ["C"]), ("IMAGE", "![left over", ["C"]),
    ]
    two = got[6]
    assert (two["image"], two["before"], two["after"]) == (2, "# A first second ## B third", "# C last") and two["char_offset"] == text.index("![](")
    assert two["embedding_text"] == "章节: A > B\n图片前文: # A first second ## B third\n图片内容: a map\n图片后文: # C last"
    assert got[9]["char_offset"] == len(text) and got[9]["after"] == "" and got[9]["embedding_text"].endswith("图片内容: left over")
    assert got[9]["content"].endswith(f"asset://{hashlib.sha256(b'y').hexdigest()[:16]})")


def test_odd_bundles(spark):
    bad = ["no json", {"version": 2, "content": "x", "images": []}, {"version": 1, "content": "x", "images": [{"id": "", "data": ""}]}]
    good = [{"version": 1, "content": "only text"}, {"version": 1, "content": "", "images": [image("a"), image("b")]}, {"version": 1, "content": None, "images": None}]
    got = blocks(spark, *bad, *good)
    assert [(r["doc"], r["kind"], r["image"]) for r in got] == [(3, "PARAGRAPH", None), (4, "IMAGE", 1), (4, "IMAGE", 2)]


def test_text_beside_images(spark):
    """500 characters of whole texts with single spaces, whatever lies between parts."""
    rng = random.Random(5)
    docs = []
    for _ in range(40):
        parts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "word " * 60]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(2, 6))]
        docs.append({"version": 1, "content": "".join(p + f"![m](clipboard-image://i{i})" for i, p in enumerate(parts[:-1])) + parts[-1], "images": [image(f"i{i}") for i in range(len(parts) - 1)]})
    got = [r for r in blocks(spark, *docs) if r["kind"] == "IMAGE"]
    for r in got:
        text = docs[r["doc"]]["content"]
        m = next(m for m in MARK.finditer(text) if m[2] == f"i{r['image'] - 1}")
        plain = lambda t: " ".join(MARK.sub("", t).split())
        assert (r["before"], r["after"], r["char_offset"]) == (plain(text[: m.start()])[-500:], plain(text[m.end() :])[:500], m.start())
    assert len(got) > 80 and any(len(r["before"]) == 500 for r in got)
