"""Rules, spans and decoding against their definitions in plain Python."""

import itertools
import math
import random
import re
import time

from pyspark.sql import functions as F

from sediment.llm import licenses, mixing, secrets, toxicity

from .test_documents import frame, labelled, prose


def detections(text):
    s = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip() + " "
    found = [(m.start(), m.end(), r["priority"], r["label"]) for r in licenses.rules() if r["keyword"] in s for m in re.finditer(r["regex"], s)]
    rank = lambda d: (d[2], d[0] - d[1], d[0], d[3])
    return {x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and rank(y) < rank(x) for y in found)}


def test_license_detections(spark):
    rng, said = random.Random(5), ["MIT License", "GNU General Public License", "version 2.0", "licensed under the", "Apache License, Version 2.0", "CC BY-SA 4.0", "All rights reserved.", "free software", "BSD 3-Clause License", "the Mozilla Public License", "or", "license", "SPDX-License-Identifier: EPL-2.0", "Neither the name of X nor the names of its contributors", "is hereby granted"]
    texts = [(i, " ".join(rng.choice(said + [prose(rng, 2)]) for _ in range(rng.randint(1, 25)))) for i in range(120)]
    for r in licenses.scan(frame(spark, texts)).collect():
        assert {(d["start"], d["end"], d["priority"], d["label"]) for d in r["detections"] or []} == detections(r["text"]), r["text"]


def test_long_license_text_takes_seconds(spark):
    text = "Licensed under the Apache License, Version 2.0. All rights reserved. MIT License, GPL v2. " * 10_000
    start = time.time()
    r = licenses.scan(frame(spark, [(1, text)])).select(F.size("detections").alias("n")).first()
    assert r["n"] >= 30_000 and time.time() - start < 60


def test_secret_spans(spark):
    rng, sign = random.Random(8), "aZ09+/_.=-:' \"\xe9\n"
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ": ", "AKIA", "deadbeef", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "secret", "qX7Rt2LmZ9vKp4WsB8nYc3Hd", "local/share/documents/international_"]
    texts = [(i, "".join(rng.choice([rng.choice(bits), "".join(rng.choices(sign, k=rng.randint(1, 8)))]) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    for r in secrets.scan(frame(spark, texts)).collect():
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, r["text"]) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", r["text"]) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", r["text"]) if len(m[0]) >= 24]
        assert [(s["start"], s["kind"], s["end"]) for s in r["base_spans"]] == sorted(want), r["text"]
        assert [(s["start"], s["end"]) for s in r["more_spans"]] == more_spans(r["text"], want), r["text"]


def more_spans(text, base):
    """What the Markov scan adds to the base spans, in plain Python."""
    out = []
    for pattern in (secrets.CANDIDATE, secrets.PART):
        found = [(m.start(), m.end()) for m in re.finditer(pattern, text) if secrets.log_ratio(m[0]) >= secrets.LEAST_RATIO]
        out += [(a, b) for a, b in found if not any(x <= a and b <= y for x, _, y in base) and not any(x <= a and b <= y for x, y in out)]
    return sorted(out)


def test_markov_scan_in_longer_runs(spark):
    key, digits, path = "qX7Rt2LmZ9vKp4WsB8nYc3Hd", "0123456789abcdef01234567", "usr/local/share/documents/international/organization/administration/responsibility/"
    texts = [(1, f"see {path * 3}{key} there"), (2, f"{path * 3}index"), (3, f"id Zq8Kx3{digits}Wv5Rt2Lm end"), (4, f"a {digits} b"), (5, f"token={key}")]
    got = {r["doc_id"]: ([s["kind"] for s in r["base_spans"]], [(s["start"], s["end"]) for s in r["more_spans"]]) for r in secrets.scan(frame(spark, texts)).collect()}
    at = 4 + 3 * len(path)
    assert got == {1: ([], [(at, at + len(key))]), 2: ([], []), 3: ([2], [(3, 41)]), 4: ([2], []), 5: ([0], [])}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, texts)).collect()}
    assert masked[1] == f"see {path * 3}[SECRET] there" and masked[3] == "id [SECRET] end"


def test_markov_scan_on_strings_not_trained_on():
    rng = random.Random(99)  # the models are trained with another seed
    wild = [secrets.random_of(rng) for _ in range(1000)]
    tame = [w for w in (secrets.words_of(rng) for _ in range(4000)) if re.fullmatch(r"[A-Za-z0-9+/_-]{20,}", w)][:1000]
    hit = [sum(secrets.log_ratio(x) >= secrets.LEAST_RATIO for x in xs) / len(xs) for xs in (wild, tame)]
    assert hit[0] >= 0.95 and hit[1] <= 0.002, hit


def paths(token, lm):
    """Every reading of a token with its cost: the channel's rules, one choice a character, nothing shared."""
    out = []

    def walk(i, a, b, cost, word, was, run):
        if i == len(token):
            out.append((cost - (lm[(a * 27 + b) * 27] if b else 0), "".join(word)))
            return
        ch = token[i]
        letters = [(ord(ch) - 96, 0.0)] if "a" <= ch <= "z" else [(ord(x) - 96, toxicity.SIGN) for x in toxicity.LEET.get(ch, "")]
        if ch == "*" and was != "*":
            letters = [(k, toxicity.HIDDEN) for k in range(1, 27)]
        run = run + 1 if ch == was else 1
        again = toxicity.DOUBLE if run == 2 and ch * 3 not in token else toxicity.REPEAT
        skip = again if run > 1 and letters else None if "a" <= ch <= "z" else toxicity.DROP_SIGN if ch in toxicity.LEET else toxicity.DROP
        if skip is not None and (b or not letters):
            walk(i + 1, a, b, cost + skip, word, ch, run)
        for c, paid in letters:
            walk(i + 1, b, c, cost + paid - lm[(a * 27 + b) * 27 + c], [*word, chr(96 + c)], ch, run)
            if b:
                walk(i + 1, 0, c, cost + paid + toxicity.BREAK - lm[(a * 27 + b) * 27] - lm[c], [*word, " ", chr(96 + c)], ch, run)

    walk(0, 0, 0, 0.0, [], "", 0)
    return out


def test_viterbi_against_every_reading(spark):
    lm = toxicity.character_model(frame(spark, [(i, t) for i, t, _ in labelled()]))
    channel, rng = toxicity.Channel(lm), random.Random(3)
    for _ in range(300):
        token = "".join(rng.choices("aeinorst01$!|.-", k=rng.randint(1, 6)))
        every = paths(token, lm)
        if every:
            got, best = channel.restore(token), min(every)
            assert math.isclose(min(c for c, w in every if w == got), best[0], rel_tol=1e-9), (token, got, best)


def test_words_not_wanted_are_not_decoded(spark):
    rows = labelled()
    lm = toxicity.character_model(frame(spark, [(i, t) for i, t, _ in rows]))
    wanted = {f: i for i, f in enumerate(["w:idiot", "5:idiot", "4:lose#2", "w:scum", "w:\xe9ab", "6:bandle"])}
    reader, all_ = toxicity.Reader(lm, wanted), toxicity.Reader(lm)
    said = ["iddioott", "moronidiot", "Bandleking!", "sc\xe9um", "\xe9ab", "sooooo", "tr@sh", "(losers)", "lo.ser", "4$$", "100%", "$#!+", "l0s3r loser"]
    for texts in itertools.chain([[t] for t in said], [said, [t for _, t, _ in rows[:40]]]):
        text = " ".join(texts)
        assert reader.features(text) == {wanted[f] for f in all_.features(text) if f in wanted}, text


def test_vocabulary_tells_domains_apart(spark):
    rows = labelled(600)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    domains = spark.createDataFrame([(i, "toxic" if y else "good") for i, _, y in rows if i % 3], "doc_id long, domain string")
    words = mixing.vocabularies(docs, domains, ["good", "toxic"])
    assert set(words["toxic"]) == {"idiot", "moron", "trash", "scum", "loser"} and words["good"] == []
    got = {r["doc_id"]: r["p_toxic"] > 0.5 for r in mixing.rates(docs, domains, {"good": 0.9, "toxic": 0.1}).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 0]
    assert sum(got[i] == bool(y) for i, y in held) >= 0.97 * len(held)
