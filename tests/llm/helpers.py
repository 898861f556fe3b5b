"""Plain versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that every text operator must take.
ODD_TEXTS = [None, "", " \n\t", "a", "one two", "x " * 40, "Ünïcödé  ﬁ ΑΣ\u00a0b\u2003c", "line\nline\nline\n\nline", "\x00\x1c odd \ufffe", "🙂 emoji 🙂 emoji", "word " * 20_000]


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *extra.values()) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame(rows, names)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
