"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams in license templates. Hits that
lie on one diagonal (place in the text minus place in the template) vote together; neighbouring diagonals that follow each
other are merged, which bridges inserted and missing words; the spans are then verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow, batch_of, broadcast_if_small, checkpointed, joined, pieces, utf8

#: Words of a k-gram: for the short base phrases, and for templates.
PHRASE_K, TEMPLATE_K = 2, 3
#: The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Texts and notices of well-known licenses, as words, with the label each stands for.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd-2-clause",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd-3-clause",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 2 1 of the license or at your option any later version",
        "lgpl",
    ),
    (
        "you should have received a copy of the gnu affero general public license along with this program",
        "agpl",
    ),
    (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means",
        "unlicense",
    ),
)
KNOWN = tuple((tuple(words.split()), label) for words, label in (*PHRASES, *TEMPLATES))
#: Diagonals this close are merged if their spans are at most GAP words apart; a span holds if this share of the template's words is matched.
NEAR, GAP, SHARE = 3, 6, 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashed(data: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased buffer, starts and ends of its words, their hashes, and each row's first word."""
    buf, at = joined(data, ends, a, b)
    buf = _LOWER[buf]
    starts, stops = H.words(buf, H.classes("alnum"))
    return buf, starts, stops, H.word_hashes(buf, starts, stops), np.append(np.searchsorted(starts, at), len(starts))


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, place: a fixed table, of phrases by shorter k-grams than of templates."""
    rows = []
    for t, (words, _) in enumerate(KNOWN):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        *_, h, _ = _hashed(raw, np.array([0, len(raw)]), 0, 1)
        rows += [(int(g), t, i) for i, g in enumerate(H.ngrams(h, gram_words(t)).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def gram_words(template: int) -> int:
    return PHRASE_K if template < len(PHRASES) else TEMPLATE_K


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rolling k-grams of each text: at an even place 2 i the shorter one of word i, after it the longer one, or the
    shorter one again where the text ends."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("grams", pa.list_(pa.int64()))])
    for batch in batches:
        data, ends = utf8(batch.column(2))
        for a, b in pieces(ends):
            *_, h, cut = _hashed(data, ends, a, b)
            short, long = H.ngrams(h, PHRASE_K), H.ngrams(h, TEMPLATE_K)
            both = np.stack([short, np.concatenate([long, short[len(long) :]])], 1).ravel().view(np.int64)
            n = np.maximum(0, np.diff(cut) - PHRASE_K + 1)
            word = np.repeat(cut[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # a longer k-gram must not reach into the next text
            whole = word + TEMPLATE_K <= np.repeat(cut[1:], n)
            pairs = both.reshape(-1, 2)[word]
            pairs[~whole, 1] = pairs[~whole, 0]
            at = (2 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)
            yield batch_of(schema, [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(pairs.ravel()))])


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
    known = [([w.encode() for w in words], label) for words, label in KNOWN]
    for batch in batches:
        data, ends = utf8(batch.column(1))
        for a, b in pieces(ends):
            buf, starts, stops, _, cut = _hashed(data, ends, a, b)
            rows = []
            for i, spans in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                x, y = int(cut[i - a]), int(cut[i - a + 1])
                base, labels, found, score = [], set(), [], 0.0
                for span in spans or ():
                    words, label = known[span["template"]]
                    s, e = max(0, span["first"]), min(y - x, span["last"])
                    here = [buf[starts[x + w] : stops[x + w]].tobytes() for w in range(s, e)]
                    if span["template"] < len(PHRASES):
                        if here == words:
                            base.append((s, label))
                            score = 1.0
                        continue
                    blocks = SequenceMatcher(None, words, here, autojunk=False).get_matching_blocks()[:-1]
                    same = sum(m.size for m in blocks) / len(words)
                    if same >= SHARE:
                        labels.add(label)
                        found.append((s + blocks[0].b, s + blocks[-1].b + blocks[-1].size, label))
                        score = max(score, min(1.0, same))
                own = {label for _, label in base}
                at = [s for s, _ in base]
                rows.append((y - x, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), score, ",".join(f"{n}:{s}:{e}" for s, e, n in sorted(found))))
            yield batch_of(schema, [batch.column(0).slice(a, b - a), *map(list, zip(*rows, strict=True))])


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of base phrases), first_word, last_word, base_labels, labels (with those of
    verified template spans), score (best verified share, 1 for a base phrase, 0 without any), spans (label:start:end in words).

    Words are runs of a-z (A-Z lower-cased), digits and non-ASCII characters. Null texts are empty; rows without a hit have
    counts 0, null places and empty labels. Rows that repeat id and text get equal results, null ids included: hits are kept
    by id and a 64-bit hash of the text. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    grams = arrow(rows, _grams, "doc_id long, hash long, grams array<long>")
    # shorter k-grams only meet phrases, longer ones only templates: their hashes differ
    hits = grams.select("doc_id", "hash", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(template_grams(spark)), "gram")
    hits = hits.withColumn("pos", F.floor(F.col("at") / 2).cast("int"))
    hits = hits.select("doc_id", "hash", "template", (F.col("pos") - F.col("place")).alias("diagonal"), "pos").dropDuplicates()
    of_template = lambda f: F.element_at(F.array(*[F.lit(f(t)) for t in range(len(KNOWN))]), F.col("template") + 1)
    k = of_template(gram_words)
    lines = hits.groupBy("doc_id", "hash", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")).withColumn("last", F.col("last") + k)
    # phrases must be whole on one diagonal; templates may shift
    full = of_template(lambda t: len(KNOWN[t][0]) - gram_words(t) + 1)
    exact = lines.where((F.col("template") < len(PHRASES)) & (F.col("votes") == full)).select("doc_id", "hash", "template", "first", "last")
    order = Window.partitionBy("doc_id", "hash", "template").orderBy("first", "diagonal")
    loose = lines.where(F.col("template") >= len(PHRASES))
    new = (F.col("first") - F.lag("last").over(order) > GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > NEAR)
    loose = loose.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    loose = loose.groupBy("doc_id", "hash", "template", "part").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    # an edit takes TEMPLATE_K votes; a span reaches as far beyond its hits as the words that may be missing
    loose = loose.where(F.col("votes") >= full * SHARE / TEMPLATE_K).select("doc_id", "hash", "template", F.greatest(F.lit(0), F.col("first") - NEAR).alias("first"), (F.col("last") + NEAR).alias("last"))
    spans = exact.unionByName(loose).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    spans = checkpointed(spans.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "spans"))
    size = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    side = broadcast_if_small(spans, 64) if size * 24 <= 4 << 20 else spans
    whole = rows.join(side, rows.doc_id.eqNullSafe(F.col("d")) & (rows.hash == F.col("h")), "left")
    return arrow(whole.select("doc_id", "text", "spans"), _verified, OUT)
