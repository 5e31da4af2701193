"""Small inputs that hold every awkward case."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use themselves
                       T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("_block", T.StringType())])

WORDS = "the of and zu été straße naïve 漢字 alpha beta gamma delta epsilon rho sigma tau upsilon phi chi psi omega river stone cloud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 60)) if rng.random() < 0.6 else "") + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def texts(seed=5, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 30)
    out = []
    for i in range(n):
        t = prose(rng, rng.choice([3, 12, 40, 90]))
        if i % 5 == 0:
            t = t + " " + shared + " " + prose(rng, 5)
        if i % 7 == 0 and out:
            w = rng.choice([x for x in out if x]).split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 11 == 0 and out:
            t = rng.choice(out)
        out.append(t)
    return out


def rows(seed=5, n=60):
    rng = random.Random(seed + 1)
    made = [(i * 3 - 20, t) for i, t in enumerate(texts(seed, n))]
    made += [(1001, None), (1002, ""), (1003, " \t\n "), (1004, "one"), (1005, "One  TWO"), (1006, "a" * 3000), (1007, prose(rng, 4000)),
             (1008, made[3][1]), (1008, made[3][1]), (1009, "x y z x y z x y z x y z"), (None, made[4][1]), (None, None), (1010, "  two  blanks\x0b and \x00 nul ")]
    return [(i, t, None if k % 9 == 0 else "en", None if k % 8 == 0 else f"src{k % 3}", None if t is None else len(t), "s", "t", "u") for k, (i, t) in enumerate(made)]


def frame(spark, data=None, partitions=4):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
