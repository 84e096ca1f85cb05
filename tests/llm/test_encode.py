import base64
import random

import pytest
from pyspark.sql import functions as F

from bagweave.llm import encode
from bagweave.llm import queries as Q
from bagweave.runtime import table

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{encode.TOKENIZERS}/{encode.VOCABULARY}.tiktoken"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})


def test_random_and_long_texts(reference):
    t, rnd = encode.ByteBpe(PATH), random.Random(4)
    pool = "abc '’s dll ve日本語ไทยहिन्दी 　\n\t  12３🎉👩‍🔬é́<|endoftext|>ÀÿŁ\x00\x1c\x85​"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(200))) for _ in range(800)]
    texts += ["", "a" * 20000, "ab" * 9000, " " * 5000, "!?" * 5000, "日" * 5000, "<|endoftext|>", "don't we'll I've"]
    for x in texts:
        assert t.encode(x) == reference.encode_ordinary(x)


def test_cuts_are_forced():
    t = encode.ByteBpe(PATH)
    for word in ("naïveté", "ありがとう", "x" * 90, "🎉🎉"):
        parts = t.fragments(word.encode())
        assert b"".join(parts) == word.encode()
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1:] + b[:1] in token for token in t.ranks)


def test_null_and_empty_have_no_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "id int, s string")
    got = {r.id: r.ids for r in rows.select("id", encode.token_ids(F.col("s")).alias("ids")).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1


def test_query_covers_every_document(spark, small, reference):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = {r.doc_id: r.ids for r in Q.p8_ids(spark, small).collect()}
    assert got == {k: reference.encode_ordinary(v) if v else [] for k, v in texts.items()}
    assert all(reference.decode(ids) == (texts[k] or "") for k, ids in got.items())
