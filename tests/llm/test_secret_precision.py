"""The Markov scan leaves ordinary text alone and finds random strings; samples are of other seeds and words than the model's."""

import random
import re
import string
import uuid

from pyspark.sql import functions as F

from sediment.llm import secrets

from .test_documents import frame

RNG = random.Random(4242)
WORDS = "harbour lantern Fenster Wolke maison rivière ventana camino orchard thunder Brücke cuchara".split()


def ordinary():
    """Texts without a secret, of forms that corpora are full of."""
    out = ["Title\n--------------------\nbody", "=" * 40, "_" * 30, "/" * 25, "A" * 24, "x" * 24, "-=" * 20, string.ascii_lowercase, string.ascii_uppercase, string.digits * 2, "xX" * 15]  # 24 hex digits and more are a base kind
    out += [str(uuid.UUID(int=RNG.getrandbits(128))) for _ in range(200)] + [f"/objects/{uuid.UUID(int=RNG.getrandbits(128))}/{RNG.choice(WORDS)}".upper() for _ in range(50)]
    out += [f"log_20{RNG.randint(10, 30)}-{RNG.randint(10, 12)}-{RNG.randint(10, 28)}_{RNG.randint(10, 23)}-{RNG.randint(10, 59)}-{RNG.randint(10, 59)}_{RNG.randint(1000, 9999)}" for _ in range(200)]
    out += ["backups/2024/01/15/101530_final", "IMG_20240115_103322_4411.jpg", "1.2.3/2024-01-15T10-33-22-000123", "+49-170-1234567-89012"]
    out += [RNG.choice("/_-").join(re.sub("[^A-Za-z]", "", RNG.choice(WORDS)) for _ in range(RNG.randint(3, 8))) for _ in range(400)]
    return out


def test_ordinary_text_has_no_spans_and_stays(spark):
    texts = list(enumerate(ordinary()))
    found = secrets.scan(frame(spark, texts)).select("text", F.size("more_spans").alias("n")).filter("n > 0").collect()
    assert not found, found[:5]
    assert {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, texts)).collect()} == dict(texts)


def test_planted_random_strings_are_found(spark):
    signs = {"letters and digits": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "_-", "lower": string.ascii_lowercase + string.digits, "upper": string.ascii_uppercase + string.digits, "hex": "0123456789abcdef"}
    planted = [(kind, "".join(RNG.choices(s, k=RNG.randint(20, 40)))) for kind, s in signs.items() for _ in range(150)]
    texts = [(i, f"see {s} there") for i, (_, s) in enumerate(planted)]
    rows = secrets.scan(frame(spark, texts)).select("doc_id", F.expr("exists(concat(base_spans, more_spans), s -> s.start <= 4 and s.end >= length(text) - 6)").alias("hit")).collect()
    assert len(rows) == len(planted)
    hit = {r["doc_id"]: r["hit"] for r in rows}
    for kind in signs:
        of = [hit[i] for i, (k, _) in enumerate(planted) if k == kind]
        assert sum(of) >= 0.95 * len(of), (kind, sum(of), len(of))
    assert sum(secrets.scan(frame(spark, texts)).select(F.size("more_spans").alias("n")).toPandas()["n"]) > 700  # most are the method's own
