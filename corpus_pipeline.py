"""Corpus pipeline: toxicity filter, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
all their columns; the last returns the packed pieces.  ``run`` writes each
stage's result as Parquet into the shared folder (``spark.checkpoint.dir``) and
reads it back, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

import uuid

from custlens.llm import exact_dedup, mixing, packing, simhash, toxicity
from custlens.llm.common import read
from custlens.session import checkpoint_dir


def drop_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def drop_near_copies(spark, docs, sf_dir):
    return simhash.drop_near_duplicates(docs, shingle=3, bits=3)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed(docs)


def pack_documents(spark, docs, sf_dir):
    import public_tokenizers

    # workers live through all stages: a small word cache leaves their memory to the others
    # groups are stretches of the mixture, so sequences keep its schedule
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=100_000, in_order=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_documents)]

# classifier, fingerprints, schedule and packing have no SQL form; tested against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
