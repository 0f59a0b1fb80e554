import random

from tarnweave.llm.licenses import GRAM, NEAR, PHRASES, TEMPLATES, license_digest, license_spans, words_of

from .data import documents, odd_rows, prose

MIT = next(text for _, text in TEMPLATES if text.startswith("Permission is hereby granted, free of charge, to any person obtaining"))


def rows():
    broken = MIT.split()
    broken.insert(20, "indeed")
    del broken[40]
    return odd_rows() + [
        (20, prose(1, 30) + " Released under the MIT License. " + prose(2, 30), "a"), (21, "Licensed under CC BY-NC 4.0.", "a"), (22, prose(3, 20) + "\n" + MIT + "\n" + prose(4, 20), "a"),
        (23, " ".join(broken), "a"), (24, "the apache license, or apache LICENSE", "a"), (25, "GNU general public license mit license cc-by", "a"), (26, "mit licenses are not it", "a"),
        (27, MIT + " Licensed under the Apache License, Version 2.0. " + MIT, "a"), (28, "permission is hereby granted to use", "a"), (29, "cc\x00by ccby ünï-cc by", "a"),
    ]


def test_phrases_like_brute_force(spark):
    got = sorted(map(tuple, license_digest(documents(spark, rows())).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    want = []
    for i, t, _ in rows():
        w, at, labels = words_of(t or ""), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            here = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=repr)


def test_labels_and_spans(spark):
    docs = documents(spark, rows())
    got = {r["doc_id"]: r for r in license_digest(docs).collect()}
    assert [got[i]["labels"] for i in (20, 21, 22, 23, 24, 28)] == ["mit", "cc-by,cc-by-nc", "mit", "mit", "apache", ""]
    assert got[27]["labels"] == "apache,mit"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[22]["score"] == 1 and 0.8 <= got[23]["score"] < 1
    spans = [r for r in license_spans(docs).collect() if r["doc_id"] == 27 and r["label"] == "mit"]
    n = len(words_of(MIT))
    assert sorted((r["first_word"], r["last_word"]) for r in spans) == [(0, n - 1), (n + 8, 2 * n + 7)]


def test_empty(spark):
    assert license_digest(documents(spark, [])).count() == 0


def brute_spans(text, templates):
    """Votes, diagonals and similarities word by word."""
    w, out = words_of(text or ""), []
    for t, (label, template) in enumerate(templates):
        v = words_of(template)
        votes = {}
        for i in range(len(w) - GRAM + 1):
            for j in range(len(v) - GRAM + 1):
                if w[i : i + GRAM] == v[j : j + GRAM]:
                    votes.setdefault(i - j, []).append((i, j))
        merged = []
        for d in sorted(votes):
            if merged and d - merged[-1][0] <= NEAR:
                merged[-1].append(d)
            else:
                merged.append([d])
        for group in merged:
            best = []
            for some in [group] + [group[i : i + n] for i in range(len(group)) for n in (1, 2, 3)]:
                at, t_at = {i for d in some for i, _ in votes[d]}, {j for d in some for _, j in votes[d]}
                similarity = min(1.0, 2 * min(len(at), len(t_at)) / (max(at) - min(at) + 1 + len(v) - GRAM + 1))
                best.append((similarity, -min(at), max(at)))
            similarity, first, last = max(best)
            out.append((label, t, -first, last + GRAM - 1, round(similarity, 9)))
    return out


def test_words_around_a_notice_do_not_take_its_label(spark):
    """Every template, with words before and after it that are often its own."""
    r = random.Random(7)
    texts = [("Licensed under CC BY-NC 4.0 (BY-NC 4.0).", "cc-by-nc"), ("Licensed under CC BY-SA 4.0, BY-SA 4.0", "cc-by-sa")]
    for label, template in TEMPLATES:
        words = words_of(template)
        for _ in range(4):
            parts = [words[(i := r.randrange(len(words))) : i + r.randrange(1, 9)] for _ in range(4)]
            texts.append((" ".join(sum(parts[:2], []) + words + sum(parts[2:], [])), label))
    got = {x["doc_id"]: x["labels"].split(",") for x in license_digest(documents(spark, [(i, t, "a") for i, (t, _) in enumerate(texts)])).collect()}
    assert [(i, t) for i, (t, label) in enumerate(texts) if label not in got[i]] == []


def test_spans_like_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = [(f"l{k % 3}", " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 40)))) for k in range(8)]
    texts = []
    for _ in range(25):
        words = []
        for _, t in r.sample(templates, 3):
            part = t.split()
            for _ in range(r.randrange(3)):
                part.insert(r.randrange(len(part)), r.choice(vocabulary))
            words += part + [r.choice(vocabulary) for _ in range(r.randrange(6))]
        texts.append(" ".join(words))
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(None, None, None)])
    got = sorted((x["doc_id"], x["label"], x["template"], x["first_word"], x["last_word"], round(x["similarity"], 9)) for x in license_spans(docs, templates=templates, threshold=0.0).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) for s in brute_spans(t, templates))


def test_long_texts(spark):
    text = prose(5, 300_000) + " " + MIT + " " + prose(6, 1000)
    got = license_spans(documents(spark, [(1, text, "a")])).collect()
    assert [(s["label"], s["first_word"]) for s in got] == [("mit", len(words_of(prose(5, 300_000))))]
