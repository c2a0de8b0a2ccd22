import hashlib
import random
import re

import numpy as np

from railpulse.llm import fill_middle as f

from .conftest import DIRS

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, documents):
    got = {r.doc_id: r for r in f.op11_fill_middle(spark, DIRS["small"]).collect()}
    assert len(got) == len(documents) and {r.form for r in got.values()} == {"plain", "spm", "psm"}
    for i, t in documents:
        n, form, p, m, out = brute(i, t or "")
        assert tuple(got[i]) == (i, n, form, p, m, sha(out), sha(t or ""))


def test_containers_select_as_a_list_does():
    rng = np.random.default_rng(1)
    kinds = set()
    for low in (np.array([0]), np.array([65535]), np.arange(65536), np.sort(rng.choice(65536, 4096, False)),
                np.sort(rng.choice(65536, 4097, False)), np.sort(rng.choice(65536, 40_000, False)),
                np.concatenate([np.arange(i, i + 50) for i in range(0, 60_000, 200)])):
        c = f.container(low)
        kinds.add(type(c).__name__)
        for make in (f.BitmapContainer, f.RunContainer, *([f.ArrayContainer] if len(low) <= f.ARRAY_MOST else [])):
            same = make(low)
            assert all(same.select(k) == low[k] for k in {0, len(low) - 1, *rng.integers(0, len(low), 200).tolist()})
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


def test_boundaries_of_long_texts():
    rng = random.Random(3)
    for text in ("a " * 100_000, "word " * 60_000 + " \n", "x" * 65_536, "x" * 65_535 + " y", "x" * 65_536 + " ", " " * 70_000,
                 "".join(rng.choice("ab  \n\té𝄞") for _ in range(300_000)), "y" * 200_000 + " z"):
        ends = f.token_ends(text.encode())
        want = np.cumsum([len(t.encode()) for t in TOKEN.findall(text)])
        assert len(ends) == len(want)
        for k in {0, len(want) - 1, *(rng.randrange(len(want)) for _ in range(300))}:
            assert ends.select(k) == want[k]
    assert len(f.token_ends(b"")) == 0


def test_edges(docs):
    rows = [(1, None), (2, ""), (None, "no id here"), (3, " lead and trail \n"), (3, " lead and trail \n"), (4, "has <S> in it"), (5, "\x0b\x0c"),
            (6, "x" * 3_000_000), (7, "né ü 𝄞 " * 50_000), (8, " not a space here"), (9, "< P><"), (10, "a <P"), (12, "S> b <")]
    rows += [(i, "<P a <S< M> <M") for i in range(100, 140)]
    got = f.fill_in_middle(docs(rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", f.restored()).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(i, *brute(i, t or "")) for i, t in rows], key=key)
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t in rows)
    assert f.fill_in_middle(docs([])).count() == 0
