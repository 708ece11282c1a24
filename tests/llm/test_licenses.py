import random
import re

import pytest

from voxelgraph.llm import license_texts, licenses


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(text):
    """Every window from every word on, against every template."""
    w = words(text)
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    hits = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels, base = {label for _, label in hits}, ",".join(sorted({label for _, label in hits}))
    own, met = [], []
    for k, (label, text, needed, absent) in enumerate(license_texts.TEMPLATES):
        t = words(text)
        own.append({f"{a} {b}" for a, b in zip(t, t[1:])} - set(absent))
        span, last = len(t) + len(t) // 4 + 1, None
        for i in range(len(pairs)):
            block = set(pairs[i : i + span - 1])
            if pairs[i] in own[k] and len(own[k] & block) / len(own[k]) >= 0.8:  # containment alone
                key = (2 * len(own[k] & block) - len(own[k]), set(needed) <= block and not set(absent) & block)
                if last is None or i - last > span:
                    met.append([k, label, i, i + span, key, 0.0])
                last, now = i, met[-1]
                now[3], now[4], now[5] = i + span, max(now[4], key), max(now[5], len(own[k] & block) / len(own[k]))
    for k, label, s, e, key, _ in met:
        sister = lambda j: license_texts.TEMPLATES[j][0] != label and 2 * len(own[k] & own[j]) >= len(own[k])
        if not any(sister(m[0]) and s < m[3] and m[2] < e and m[4] > key for m in met):
            labels.add(label)
    best = max((m[5] for m in met), default=0.0)
    return (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, base, ",".join(sorted(labels)), 1.0 if hits else best)


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "c", 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, w int, row_id int")
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect()}


def test_against_every_window_and_template(spark):
    rng = random.Random(6)
    pool = sorted({w for _, t, *_ in license_texts.TEMPLATES[-6:] for w in words(t)})[:30] + ["foo", "bär", "É"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 20, 33, 90]))) for _ in range(100)]
    for _ in range(150):  # templates with words lost, doubled or put in between
        w = [x for _, t, *_ in rng.sample(license_texts.TEMPLATES, 2) for x in words(t)]
        for _ in range(rng.choice([0, 1, 3, len(w) // 12, len(w) // 8])):
            i = rng.randrange(len(w))
            w[i : i + rng.choice([0, 1])] = rng.choice([[], ["foo"], [w[i], w[i]]])
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) + " " + " ".join(w))
    texts += ["ALL RIGHTS RESERVED all rights reserved", "cc by cc by cc", None, "", "Icc by", "cc\nby\x00", "İcc by K"]
    got = scanned(spark, texts)
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert len({r[5] for r in got.values()}) > 40
    df = spark.createDataFrame([(1, "under the mit license")] * 2, "doc_id long, text string")
    assert licenses.scan(df.limit(0)).count() == 0 and [r.labels for r in licenses.scan(df).collect()] == ["mit"] * 2


#: Texts as people write them, and the labels that a reader gives them.
LABELLED = (
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("under the terms of the GNU General Public License version 2 only", "gpl,gpl-2.0"),
    ("Released under the GNU Affero General Public License, version 3.", "agpl-3.0,gpl"),
    ("may be used under the GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("MIT. All rights reserved.", "reserved"),
    ("The public license of a general nature was granted free of charge to any person.", ""),
    ("Redistribution of wealth in source and binary forms of the argument, with or without modification.", ""),
    ("Version 2.0 of the licence of an Apache helicopter", ""),
)


@pytest.mark.parametrize("label", sorted({t[0] for t in license_texts.TEMPLATES}))
def test_list_has_what_each_license_needs(label):
    assert all(set(needed) <= {f"{a} {b}" for a, b in zip(words(t), words(t)[1:])} for lab, t, needed, _ in license_texts.TEMPLATES if lab == label)


def test_labels_that_a_reader_gives(spark):
    filler = "lorem ipsum dolor sit amet " * 30
    whole = [t for t in license_texts.TEMPLATES if len(t[1]) > 200]
    wrapped = [filler + "\n * ".join(re.findall(r"\S+(?:\s+\S+){0,6}", t[1])) + filler for t in whole]
    # copyright holders named, a line left out, and only the latter half of a license
    named = ["Copyright 2020 Jane Doe.\n" + t[1].replace("copyright holder", "University of Somewhere") for t in whole]
    half = [t[1][len(t[1]) // 2 :] for t in whole]
    got = scanned(spark, [t for t, _ in LABELLED] + wrapped + named + half + ["x " * 100_000 + "Released under the MIT License."])
    own = lambda r: {x for x in r[5].split(",") if x} - {"gpl"}
    n, m = len(LABELLED), len(whole)
    assert [got[i][5] for i in range(n)] == [x for _, x in LABELLED]
    assert [own(got[n + i]) for i in range(m)] == [{t[0]} for t in whole]
    assert [own(got[n + m + i]) for i in range(m)] == [{t[0]} for t in whole]
    assert [own(got[n + 2 * m + i]) for i in range(m)] == [set()] * m
    assert got[n + 3 * m][5] == "mit" and got[n + 3 * m][0] == 100_005


def test_containment_decides_and_telling_pairs_only_choose(spark):
    whole = {label: t for label, t, *_ in license_texts.TEMPLATES if len(t) > 200}
    changed = whole["mit"].replace("substantial portions of the", "parts of the")
    stray = whole["bsd-2-clause"] + " We do not endorse or fund this."
    both = whole["bsd-3-clause"] + " lorem ipsum dolor" * 600 + " " + whole["bsd-2-clause"]
    got = scanned(spark, [changed, stray, both])
    assert changed != whole["mit"] and got[0][5] == "mit" and 0.9 < got[0][6] < 1
    assert got[1][5] == "bsd-2-clause" and got[1][6] == 1.0
    assert got[2][5] == "bsd-2-clause,bsd-3-clause"
