import random

from railpulse.llm import license_scan as s

from .conftest import DIRS

LINES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
         "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}


def test_query_finds_planted_lines(spark, documents):
    got = sorted((r.doc_id, r.license) for r in s.op2_license_scan(spark, DIRS["small"]).collect())
    assert got == sorted((i, v) for i, t in documents for k, v in LINES.items() for _ in range(t.count(k)))


def test_wording_decides():
    notice = s.TEMPLATES["MIT-notice"]
    assert [x[0] for x in s.scan(f"é\n{notice}\nmore".encode())] == ["MIT"]
    assert s.scan(f"é\n{notice}\nmore".encode())[0][1] == 2
    changed = notice.replace("free of charge", "for a fee").encode()
    assert s.scan(changed)[0][4] > 0  # one phrase differs: still that licence, and the difference is told
    assert not s.scan(b"The licence of the hall was renewed with permission of the council, it said, after long talks.")
    both = s.scan(b"Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")
    assert [x[0] for x in both] == ["CC-BY-4.0", "CC-BY-NC-4.0", "MIT"]
    assert s.ranked(notice.encode())[0][1] == "MIT-notice"


def test_edges(docs):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "Released under the MIT License."),
            (3, "Released under the MIT License."), (4, "permission " * 3000)]
    assert sorted((r.doc_id or 0, r.license) for r in s.licenses(docs(rows)).collect()) == [(0, "MIT"), (3, "MIT"), (3, "MIT")]
    assert s.licenses(docs([])).count() == 0


def test_long_blocks_hide_no_notice(documents):
    """Exact notices in one line of prose of 4 to 100 KB."""
    prose = " ".join(t.replace("\n", " ") for _, t in documents if t and not s.scan(t.encode()))
    while len(prose) < 110_000:
        prose += " " + prose
    for size in (4_000, 10_000, 40_000, 100_000):
        for line, name in LINES.items():
            text = f"{prose[:size // 2]} {line} {prose[size // 2:size]}"
            got = s.scan(text.encode())
            assert [(x[0], x[4], x[5]) for x in got] == [(name, 0, 0)]
            assert text[got[0][1]:got[0][2]] == line.rstrip(".")
        both = f"{prose[:size]} {' '.join(LINES)} {prose[:size]} {s.TEMPLATES['BSD']} {prose[:99]}"
        assert [x[0] for x in s.scan(both.encode())] == [*LINES.values(), "BSD"]


def test_partial_quote_before_a_changed_notice():
    notice = s.TEMPLATES["GPL-3.0-notice"]
    changed = notice.replace("redistribute", "share").replace("published", "issued")
    quote = " ".join(notice.split()[:22])
    for text in (changed, f"The text says: {quote}, and so on. {changed}", f"{changed} The text says: {quote}."):
        got = s.scan(text.encode())
        assert [(x[0], x[4], x[5]) for x in got] == [("GPL-3.0", 2, 2)]
        assert text[got[0][1]:got[0][2]] == changed.rstrip(".")


def test_alignment_with_fewest_differences():
    """Equal to comparing a template with every span of words."""
    def least(template, words):
        best = None
        for first in range(len(words)):
            row = list(range(len(template) + 1))  # template[:k] against words[first:last]
            for last in range(first, min(len(words), first + 2 * len(template))):
                new = [row[0] + 1]
                for k, w in enumerate(template):
                    new.append(min(row[k + 1] + 1, new[k] + 1, row[k] if w == words[last] else 9999))
                row = new
                best = min(x for x in (best, row[-1]) if x is not None)
        return best

    rng = random.Random(3)
    for name in ("GPL-3.0", "Unlicense", "ISC", "GPL-3.0-notice"):
        template = [w for w, _, _ in s.words_of(s.TEMPLATES[name].encode())]
        for _ in range(25):
            words = list(template)
            for _ in range(rng.randrange(s.slack(len(template)) + 2)):
                at = rng.randrange(len(words))
                words[at:at + rng.randrange(2)] = [b"x"] * rng.randrange(2)
            words = [b"y"] * rng.randrange(4) + template[:rng.randrange(len(template) // 2)] + words + [b"z"] * rng.randrange(4)
            got = [x[2] + x[3] for x in s.notices(words) if x[4] == name]
            right = least(template, words)
            assert (min(got) if got else None) == (right if right <= s.slack(len(template)) else None)
