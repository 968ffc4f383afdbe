"""Subjects of documents, by label propagation over a graph of documents, paragraphs and passages.

A passage is a sentence reduced to its words (lower case, without numbers, places and marks), so that documents which share a
sentence share a node. Two passages are linked if they are equal once at most one word is taken out of each; the links run
through nodes of their own, the passages without one word, so none is lost, no pairs are made, and their number grows with the
text. Equal nodes are the check of a link: with n words it is a Jaccard similarity of (n - 1) / (n + 1) at least, and passages
too short for the similarity asked for have no such nodes. Subjects spread from the documents labelled by hand to their
paragraphs, from there to passages, over the links to like passages, and back to all paragraphs, by joins and aggregates, until
no more passages change; labelled documents are clamped to their labels in every round. What is spread evenly over the subjects
(chatter) carries none. A document gets every subject to which a paragraph is given over.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that show nothing: soft hyphen, zero-width characters, variation selector.
UNSEEN = "[\u00ad\u200b\u200c\u200d\u2060\ufeff\ufe0f\x1d\x1e]"
#: A paragraph ends at a blank line, a sentence at white space after a mark; both get a mark of their own, which no text has.
PARAGRAPH, PARAGRAPH_END = r"\r?\n[ \t\r\x{00A0}]*\n\s*", "\x1d"
SENTENCE, SENTENCE_END = r"([.!?])\s+", "\x1e"
#: Tokens with digits; then all that is no letter (but for the single blanks that stand between words already).
NUMBERED, NO_LETTER = r"[\p{L}\p{M}]*[0-9][\p{L}\p{M}0-9]*", r"[^\p{L}\p{M} \x1d\x1e][^\p{L}\p{M}\x1d\x1e]*| [^\p{L}\p{M}\x1d\x1e]+"
#: Nodes that a row of a batch's nodes holds.
NODES_A_ROW = 2000


def skeletons(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of every paragraph of every text the number of the text, and its sentences of two words or more as lists of words joined by blanks."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), UNSEEN, "")
    plain = pc.replace_substring_regex(plain, PARAGRAPH, PARAGRAPH_END)
    plain = pc.replace_substring_regex(plain, SENTENCE, r"\1" + SENTENCE_END)
    plain = pc.replace_substring_regex(pc.replace_substring_regex(plain, NUMBERED, " "), NO_LETTER, " ")
    pars = pc.split_pattern(plain, PARAGRAPH_END)
    of_par = pc.list_parent_indices(pars).to_numpy(zero_copy_only=False)
    each = pc.split_pattern(pc.list_flatten(pars), SENTENCE_END)
    of_sentence = pc.list_parent_indices(each).to_numpy(zero_copy_only=False)
    words = pc.utf8_trim(pc.list_flatten(each), " ")
    keep = pc.match_substring(words, " ")
    n = np.bincount(of_sentence[keep.to_numpy(zero_copy_only=False)], minlength=len(of_par))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), words.filter(keep))
    full = pa.array(n > 0)
    return of_par[n > 0], lists.filter(full)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of, lists = skeletons(b["text"].cast(pa.string()))
        coded = pc.dictionary_encode(lists.flatten())
        names = coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names)).view(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        none = lambda k, t: pa.nulls(k, pa.list_(t))
        yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(of)), pa.ListArray.from_arrays(at, pa.array(hashes[codes])), none(len(n), pa.int64()), none(len(n), pa.string())], names=["doc_id", "skeletons", "n", "words"])
        counts = np.bincount(codes, minlength=len(names))
        starts = np.append(np.arange(0, len(names), NODES_A_ROW), len(names)) if names else np.zeros(1, int)
        cut = lambda x: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(starts) - 1, b["doc_id"].type), cut(pa.array(hashes)), cut(pa.array(counts)), cut(coded.dictionary)], names=["doc_id", "skeletons", "n", "words"])


def passages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row (doc_id, par, skeletons) per paragraph with a sentence of two words or more, and beside them rows (skeletons, n, words) of the nodes that each batch has.

    ``par`` tells paragraphs apart, those of repeated documents too; its numbers hold once the result is materialised. Null, empty
    and blank texts have no rows. No shuffle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    out = slim.mapInArrow(_passages, f"doc_id {kind}, skeletons array<bigint>, n array<bigint>, words array<string>")
    return out.withColumn("par", F.monotonically_increasing_id())


#: A node counts as hot from this part of all rows on; there can be no more than 1 / HOT of them, which bounds what is broadcast.
HOT = 1 / 500
SALTS = 16


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, salts): the at most 1 / HOT keys that hold a part of HOT or more of all ``total`` rows. ``counts``: (key, n)."""
    return counts.where(F.col("n") >= max(2.0, total * HOT)).select(key, F.least(F.lit(SALTS), F.ceil(F.col("n") / max(1.0, total * HOT))).cast("int").alias("salts"))


def salted(rows: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``salt``, which deals the rows of a hot key to several tasks by ``by``; 0 for all other keys."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def spread(one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``one``, which has a row per key, with that row once for every ``salt`` of its key."""
    return one.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


#: An odd 64-bit number whose powers tell the places of words apart, and another that mixes bits.
BASE, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def patterns(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of passages, as 64-bit hashes: of each its passage's number, and itself. Words are joined by blanks; no passage has a pattern twice.

    The hash of a list of words is a polynomial of the words' hashes, so that of a list without a word is a sum over those before and those after it.
    """
    lists = pc.split_pattern(words, " ")
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
    start = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - start[row]
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(n.max(initial=0)), BASE)]))
        zero = np.zeros(1, np.uint64)
        here, shifted = (np.concatenate([zero, np.cumsum(hashes * powers[i], dtype=np.uint64)]) for i in (at, np.maximum(at - 1, 0)))
        k = np.arange(len(row))
        without = here[k] - here[start[row]] + shifted[start[row + 1]] - shifted[k + 1]
        new = np.flatnonzero((at == 0) | (hashes != np.roll(hashes, 1)))  # a repeated word may be taken out once
        raw = np.concatenate([without[new], here[start[1:]] - here[start[:-1]]]) + np.concatenate([n[row[new]] - 1, n]).astype(np.uint64)
        for _ in range(2):
            raw = (raw ^ (raw >> np.uint64(32))) * MIXER
    return np.concatenate([row[new], np.arange(len(n))]), (raw ^ (raw >> np.uint64(32))).view(np.int64)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of, keys = patterns(b["words"].cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(keys), b["skeleton"].take(pa.array(of))], names=["pattern", "skeleton"])


def links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(pattern, skeleton, n): the link nodes that two or more passages share, and how many share each. ``nodes``: (skeleton, words). One shuffle.

    A passage of n words has n + 1 patterns, itself and itself without each word, if (n - 1) / (n + 1) is ``similarity`` or more.
    """
    least = math.ceil((1 + similarity) / (1 - similarity) - 1e-9)
    long_enough = nodes.where(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1 >= least)
    keyed = long_enough.select("skeleton", "words").mapInArrow(_patterns, "pattern bigint, skeleton bigint").where("pattern IS NOT NULL AND skeleton IS NOT NULL").repartition("pattern")
    # both sides need the same columns, so that they share the exchange
    shared = keyed.groupBy("pattern").agg(F.count("*").alias("n"), F.min("skeleton").alias("first"), F.max("skeleton").alias("last")).where("first <> last").select("pattern", "n")
    return keyed.join(shared, "pattern").select("pattern", "skeleton", "n")


def document_subjects(
    docs: DataFrame, labels: DataFrame, keep: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", text: str = "text", similarity: float = 0.6, even: float = 0.4, sure: float = 0.5, least: int = 3, link_weight: float = 2.0, settled: float = 0.005, most_rounds: int = 20
) -> DataFrame:
    """(doc_id, subject): every subject to which at least one paragraph of the document is given over.

    ``labels``: (doc_id, subject), the trusted seeds; rows with nulls are ignored, repeated ones count once. A paragraph is given
    over to a subject if ``least`` or more of its sentences, and more of them than of any other subject, are on it. Texts without sentences
    (null, empty, blank, tables of numbers) have no subject; without labels the result is empty. A null id is kept, repeated rows change nothing. Documents with the same text
    get the same subjects unless labels set them apart. A passage's score for a subject carries nothing up to ``even``, at first
    up to the subject's share of labelled documents (which chatter has too) plus ``even`` of the way from there to 1; ``sure`` makes it a passage on that subject. Rounds
    end when no more than a ``settled`` part of the passages with a subject change theirs; a warning is given if ``most_rounds`` do not
    reach that. ``keep`` materialises intermediates (a checkpoint).
    """
    raw = keep(passages(docs, doc_id, text))
    pars = raw.where("words IS NULL").select("doc_id", "par", F.size("skeletons").alias("size"), "skeletons")
    every = raw.where("words IS NOT NULL").select(F.inline(F.arrays_zip("skeletons", "n", "words"))).withColumnRenamed("skeletons", "skeleton")
    nodes = keep(every.groupBy("skeleton").agg(F.sum("n").cast("double").alias("n"), F.max("words").alias("words")))
    occurrences = nodes.agg(F.sum("n")).first()[0] or 0.0
    hot = keep(hot_keys(nodes, "skeleton", int(occurrences)))
    member = keep(links(nodes, similarity))
    hot_patterns = keep(hot_keys(member.select("pattern", "n").distinct(), "pattern", member.count()))
    member = member.select("pattern", "skeleton")
    # subjects are numbers until the end
    trusted = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", F.xxhash64("subject").alias("subject"), F.col("subject").alias("name"))
    seeds = keep(trusted.groupBy("doc_id").agg(F.collect_set("subject").alias("own")))
    names = keep(trusted.select("subject", "name").distinct())
    rate = F.count("*") / F.lit(max(1, seeds.count()))
    floors = keep(seeds.select(F.explode("own").alias("subject")).groupBy("subject").agg((rate + even * (1 - rate)).alias("floor")))

    # a passage's first score is the part of its labelled occurrences whose document has the subject: near 1 on the subject, far lower for chatter
    on_seeds = pars.join(seeds, "doc_id").select(F.explode("skeletons").alias("skeleton"), "own")
    mass = on_seeds.select("skeleton", F.explode(F.concat("own", F.array(F.lit(None).cast("long")))).alias("subject")).groupBy("skeleton", "subject").agg(F.count("*").cast("double").alias("mass"))
    scores = keep(_smoothed(mass, member, hot_patterns, link_weight))
    best = keep(_best(scores, sure))
    every_total = nodes.select("skeleton", F.lit(None).cast("long").alias("subject"), F.col("n").alias("mass"))
    occ = salted(pars.select("doc_id", "par", "size", F.explode("skeletons").alias("skeleton")), "skeleton", hot, F.col("par"))
    for number in range(most_rounds):
        # labels are of documents, so chatter has the subjects' shares at first; shares of paragraphs know no such base
        floored = scores.join(floors, "subject") if number == 0 else scores.withColumn("floor", F.lit(even))
        lift = floored.where("score > floor").select("skeleton", "subject", ((F.col("score") - F.col("floor")) / (1 - F.col("floor"))).alias("lift"))
        q = occ.join(spread(lift, "skeleton", hot), ["skeleton", "salt"]).select("doc_id", "par", "size", "subject", "lift").repartition("par")
        q = q.groupBy("par", "subject").agg(F.sum("lift").alias("e"), F.first("size").alias("size"), F.first("doc_id").alias("doc_id"))
        # labelled documents stay clamped to their labels
        q = q.join(seeds, "doc_id", "left").where("own IS NULL OR array_contains(own, subject)")
        q = q.withColumn("whole", F.sum("e").over(Window.partitionBy("par")))
        q = q.select("par", "subject", (F.col("e") / F.col("whole") * F.least(F.lit(1.0), F.col("whole") / (0.3 * F.col("size")))).alias("q"))
        mass = pars.select("par", "skeletons").join(q, "par").select(F.explode("skeletons").alias("skeleton"), "subject", "q").groupBy("skeleton", "subject").agg(F.sum("q").alias("mass"))
        scores = keep(_smoothed(mass.unionByName(every_total), member, hot_patterns, link_weight))
        before, best = best, keep(_best(scores, sure))
        changed = best.join(before.withColumnRenamed("subject", "was"), "skeleton", "full_outer").agg(F.count_if(~F.col("subject").eqNullSafe(F.col("was"))).alias("c"), F.count("*").alias("n")).first()
        if changed["c"] <= settled * changed["n"]:
            break
    else:
        warnings.warn(f"subjects still change after {most_rounds} rounds", stacklevel=2)
    counts = occ.join(spread(best, "skeleton", hot), ["skeleton", "salt"]).groupBy("doc_id", "par", "subject").agg(F.count("*").alias("c"))
    given = counts.withColumn("most", F.max("c").over(Window.partitionBy("par"))).where((F.col("c") >= least) & (F.col("c") == F.col("most")))
    return given.select("doc_id", "subject").distinct().join(names, "subject").select("doc_id", F.col("name").alias("subject"))


def _best(scores: DataFrame, sure: float) -> DataFrame:
    """(skeleton, subject): the subject of the passages that are surely on one."""
    return scores.where(F.col("score") >= sure).groupBy("skeleton").agg(F.max(F.struct("score", "subject")).alias("b")).select("skeleton", F.col("b.subject").alias("subject"))


def _smoothed(mass: DataFrame, member: DataFrame, hot_patterns: DataFrame, link_weight: float) -> DataFrame:
    """(skeleton, subject, score): a passage's own share of each subject, drawn towards that of the passages which it is linked to.

    ``mass``: (skeleton, subject, mass), where the row without a subject holds the passage's whole mass. The same sums per link
    node, scaled to a whole of ``link_weight``, are added to every passage of the node.
    """
    # without the null skeletons that there are none of, as the joins infer it, so that all uses share one exchange
    own = mass.where("skeleton IS NOT NULL").groupBy("skeleton", "subject").agg(F.sum("mass").alias("mass"))
    by_pattern = member.join(own, "skeleton").groupBy("pattern", "subject").agg(F.sum("mass").alias("mass"))
    whole = lambda key: F.max(F.when(F.col("subject").isNull(), F.col("mass"))).over(Window.partitionBy(key))
    scaled = by_pattern.withColumn("whole", whole("pattern")).select("pattern", "subject", (F.col("mass") / F.col("whole") * link_weight).alias("mass"))
    pull = salted(member, "pattern", hot_patterns, F.col("skeleton")).join(spread(scaled, "pattern", hot_patterns), ["pattern", "salt"]).select("skeleton", "subject", "mass")
    both = own.unionByName(pull).groupBy("skeleton", "subject").agg(F.sum("mass").alias("mass"))
    return both.withColumn("whole", whole("skeleton")).where("subject IS NOT NULL").select("skeleton", "subject", (F.col("mass") / F.col("whole")).alias("score"))
