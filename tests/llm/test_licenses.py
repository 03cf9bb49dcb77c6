import random
import re

from tallyweave.llm.licenses import TEMPLATES, bands_for, scan


def test_bands_reach_the_promised_probability():
    for s in (0.05, 0.2, 0.5, 0.9, 1.0):
        bands, rows = bands_for(s)
        assert (1 - s**rows) ** bands <= 1.01e-6


def contained(text, template):
    """Best containment over all runs of twice the template's words."""
    w, t = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.lower()) for x in (text, template))
    n = min(5, len(t))
    want = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    best = 0.0
    for a in range(max(1, len(w) - len(t) + 1)):
        run = w[a : a + len(t)]
        best = max(best, len(want & {tuple(run[i : i + n]) for i in range(len(run) - n + 1)}) / len(want))
    return best


def test_finds_whole_and_edited_templates_as_brute_force_does(spark):
    r = random.Random(6)
    fill = "one two three four five six seven eight nine ten version license under the".split()
    docs = []
    for i in range(200):
        parts = [r.choice(fill) for _ in range(r.randrange(60))]
        name = r.choice([*TEMPLATES, None])
        if name:
            words = TEMPLATES[name].split()
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = "edited"
            at = r.randrange(len(parts) + 1)
            parts[at:at] = words
        docs.append((i, "\n".join(parts)))
    docs += [(900, None), (901, ""), (902, "MIT"), (903, ("Released under the MIT License. " + "x " * 50) * 40), (903, "é Licensed under CC BY-NC 4.0.")]
    table = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, license string").repartition(3)
    rows = scan(table).collect()
    found = {(x.id, x.license) for x in rows}
    want = {(d, k) for d, t in docs[:200] for k in TEMPLATES if contained(t, TEMPLATES[k]) >= 0.8}
    assert found >= want
    assert all(x.containment >= 0.8 for x in rows)
    assert sum(x.id == 903 and x.license == "MIT" for x in rows) == 40
    one = next(x for x in rows if x.id == 903 and x.license == "CC-BY-NC-4.0")
    assert "é Licensed under CC BY-NC 4.0."[one.start : one.stop] == "Licensed under CC BY-NC 4.0"
    assert scan(table.limit(0)).collect() == []


def test_every_place_is_a_row(spark):
    short, long = TEMPLATES["MIT"], TEMPLATES["MIT-text"]
    docs = [(1, f"{short} word {short}"), (2, f"{short} {short} {short}"), (3, f"a {long} b {long} c"), (4, f"{long} {long.replace('charge', 'cost')}"), (5, "nothing here")]
    rows = scan(spark.createDataFrame(docs, "doc_id long, text string"), {"short": short, "long": long}).collect()
    got = sorted((x.id, x.license, docs[x.id - 1][1][x.start : x.stop].rstrip(".")) for x in rows)
    bare = long.rstrip(".")
    want = [(1, "short", short.rstrip("."))] * 2 + [(2, "short", short.rstrip("."))] * 3 + [(3, "long", bare)] * 2 + [(4, "long", bare), (4, "long", bare.replace("charge", "cost"))]
    assert got == sorted(want)
