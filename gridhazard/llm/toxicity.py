"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Every voter says "toxic" or abstains. The votes of all documents that may be learnt from are counted by vote
pattern (at most 2**voters patterns, whatever the input). The label model explains these counts by a hidden
class: voters that stay correlated within a class form small groups with a joint table each, the groups are
independent given the class, and expectation-maximisation estimates class shares and tables. Rows with a known
label hold their class fixed. The posterior of each pattern then labels a bounded sample of rows, and a logistic
model on votes, hashed words and hashed word beginnings is trained on these posterior labels; it scores every
whole text.

The sample holds at most about ``max_rows`` rows, taken by a hash of the row: half of them with a known label, four
tenths without one but marked by a voter, a tenth of others, however large the input is. Known rows are trained on
their labels, all others on the posterior of the label model. All counts cover all rows. Null and
empty texts have no words: their score is that of a text without votes. Null ids, labels and unknown ids teach
nothing beyond their votes; of repeated labels of an id the largest counts. With nothing to learn from, voters
keep their assumed accuracies. Repeated rows get equal scores. Extra columns are not read, or kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.llm.bytescan import ASCII_LOWER, SpanHasher, byte_class, span_hashes, text_chunks, word_spans, words_of_rows
from gridhazard.llm.common import draw
from gridhazard.session import cut_lineage

LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Lexicon voters: one for each word family, in the languages of the corpus.
LEXICON = {
    "fool": "idiot idiots fool fools imbecile imbécile imbéciles idiota idiotas dummkopf trottel crétin cretin",
    "dull": "stupid stupide stupides dumb moron morons dumm estúpido estúpida tonto tonta bête simpleton",
    "failure": "loser losers failure versager perdedor perdedora raté",
    "scorn": "pathetic worthless useless wertlos patético patética pathétique inútil nul",
    "filth": "disgusting gross vile filthy ekelhaft dégoûtant dégoûtante asqueroso asquerosa repulsive",
    "waste": "trash garbage rubbish scum vermin abschaum müll basura ordure escoria filth",
    "mockery": "clown clowns joke buffoon witzfigur payaso bouffon laughingstock",
    "hatred": "hate hates hated hateful despise loathe hasse odio déteste detest",
    "profanity": "damn damned crap hell bastard bastards shit fuck fucking bitch asshole scheisse mierda merde",
    "threat": "kill murder destroy hurt punch umbringen matar tuer",
}
YOU = "you your youre du dein deine tu tú eres vous sie"
NAMES = (*LEXICON, "several", "dense", "addressed")
ASSUMED = (0.3, 0.01)  # share of toxic and of other texts a voter is taken to mark before anything is learnt
DIMS = 1 << 18
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word that make a feature of their own
#: Shares of the sample: rows with a known label, rows without one that some voter marks, other rows.
SHARES = {"known": 0.5, "marked": 0.4, "other": 0.1}
HIT = 8  # words on either side in which "you" counts as addressed


def word_set(text):
    data = np.frombuffer(" ".join(text.split()).encode(), np.uint8)
    return span_hashes(data, *word_spans(data, np.array([0, len(data)]), LETTERS), ASCII_LOWER)


def lexicon_table():
    """Sorted hashes of all lexicon words and the voter of each."""
    hashes = [word_set(words) for words in LEXICON.values()]
    flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    order = np.argsort(flat)
    return flat[order], owner[order], np.sort(word_set(YOU))


def votes_of(words, first, table):
    """Rows x voters: what each voter says of each row of word hashes."""
    flat, owner, you = table
    n = len(first) - 1
    at = np.searchsorted(flat, words)
    at[at == len(flat)] = 0
    spots = np.flatnonzero(flat[at] == words)
    rows, voter = np.searchsorted(first, spots, "right") - 1, owner[at[spots]]
    votes = np.zeros((n, len(NAMES)), bool)
    votes[rows, voter] = True
    k = len(LEXICON)
    total = np.bincount(rows, minlength=n)
    votes[:, k] = votes[:, :k].sum(axis=1) > 1
    votes[:, k + 1] = total * 100 > np.diff(first)
    said = np.concatenate([[0], np.cumsum(np.isin(words, you))])
    near = said[np.minimum(spots + HIT + 1, first[rows + 1])] > said[np.maximum(spots - HIT, first[rows])]
    votes[rows[near], k + 2] = True
    return votes


def parsed(column):
    """For each chunk of texts: (word hashes, first word of each row, feature slots and the word of each)."""
    for _, data, offs in text_chunks(column, CHUNK):
        starts, ends = word_spans(data, offs, LETTERS)
        hashed = SpanHasher(data, ASCII_LOWER)
        words = hashed(starts, ends)

        def slots(starts=starts, ends=ends, hashed=hashed, words=words):
            yield words % DIMS, np.arange(len(words))
            for size in BEGINNINGS:
                at = np.flatnonzero(ends - starts > size)
                yield hashed(starts[at], starts[at] + size) % DIMS, at

        yield words, words_of_rows(starts, offs), slots


def pack(votes):
    return (votes.astype(np.int64) << np.arange(votes.shape[1])).sum(axis=1)


def unpack(patterns):
    return (np.asarray(patterns)[:, None] >> np.arange(len(NAMES)) & 1).astype(bool)


class LabelModel:
    """Two hidden classes; groups of correlated voters with a joint table each."""

    def __init__(self, votes, gold, count, rounds=60, link=0.15, largest=4):
        # votes: patterns x voters, gold: 1, 0 or -1, count: rows of each
        self.groups = [[j] for j in range(votes.shape[1])]
        known = gold >= 0
        q = np.where(known, gold, np.where(votes.any(axis=1), 0.8, 0.05)).astype(float)
        for _ in range(rounds // 3):
            self._learn(votes, count, q)
            q = np.where(known, gold, self.posterior(votes))
        self.groups = self._correlated(votes, count, q, link, largest)
        for _ in range(rounds):
            self._learn(votes, count, q)
            q = np.where(known, gold, self.posterior(votes))

    def _state(self, votes, group):
        return (votes[:, group].astype(np.int64) << np.arange(len(group))).sum(axis=1)

    def _learn(self, votes, count, q):
        self.share = (np.sum(q * count) + 1) / (count.sum() + 20)
        self.tables = []
        for group in self.groups:
            size, state = 1 << len(group), self._state(votes, group)
            ones = np.array([bin(s).count("1") for s in range(size)])
            pair = []
            for weight, rate in ((q * count, ASSUMED[0]), ((1 - q) * count, ASSUMED[1])):
                prior = rate ** ones * (1 - rate) ** (len(group) - ones)  # worth ten rows
                pair.append((np.bincount(state, weight, size) + 10 * prior) / (weight.sum() + 10 * prior.sum()))
            self.tables.append(pair)

    def posterior(self, votes):
        logit = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for group, (yes, no) in zip(self.groups, self.tables):
            logit += (np.log(yes) - np.log(no))[self._state(votes, group)]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    @staticmethod
    def _correlated(votes, count, q, link, largest):
        """Voters whose votes stay correlated within the classes, strongest pairs first, in groups of bounded size."""
        v, strength = votes.astype(float), 0.0
        for weight in (q * count, (1 - q) * count):
            total = max(weight.sum(), 1e-9)
            mean = weight @ v / total
            cov = (v * weight[:, None]).T @ v / total - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            strength = np.maximum(strength, np.abs(cov) / np.outer(sd, sd) * (total > 10))
        owner = list(range(len(NAMES)))
        pairs = sorted(((strength[i, j], i, j) for i in range(len(NAMES)) for j in range(i)), reverse=True)
        for s, i, j in pairs:
            a, b = owner[i], owner[j]
            if s >= link and a != b and owner.count(a) + owner.count(b) <= largest:
                owner = [a if o == b else o for o in owner]
        return [[k for k, o in enumerate(owner) if o == name] for name in dict.fromkeys(owner)]


def features(first, slots):
    """Feature slots of each row, each once, with count over the root of the row's words."""
    parts = [(s.astype(np.int64), np.searchsorted(first, at, "right") - 1) for s, at in slots()]
    n = len(first) - 1
    slot, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key, count = np.unique(row * DIMS + slot, return_counts=True)
    root = np.sqrt(np.maximum(np.diff(first), 1))
    return key % DIMS, count / root[key // DIMS], np.searchsorted(key, np.arange(n + 1) * DIMS)


def margins(weights, first, slots, votes):
    """Linear scores of rows: weights of their features and votes, and a constant."""
    total = np.zeros(len(first) - 1)
    for slot, at in slots():
        sums = np.concatenate([[0.0], np.cumsum(weights[slot.astype(np.int64)])])
        edge = np.searchsorted(at, first)
        total += sums[edge[1:]] - sums[edge[:-1]]
    return total / np.sqrt(np.maximum(np.diff(first), 1)) + votes @ weights[DIMS:-1] + weights[-1]


def train(slot, value, at, votes, target, rounds=250, decay=(2e-5, 1e-5), rate=0.1, rare=12):
    """Logistic regression on soft labels by full-batch Adam; slots of fewer than ``rare`` rows keep weight 0."""
    n, flags = len(target), votes.astype(float)
    common = np.bincount(slot, minlength=DIMS) >= rare
    used, place = np.flatnonzero(common), np.cumsum(common, dtype=np.int32) - 1
    kept = common[slot]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))[kept]
    slot, value = place[slot[kept]], value[kept]
    cuts = range(0, n, 500)  # rows taken at once: temporaries of doubles stay small
    runs = [(lo, min(lo + 500, n), slice(*np.searchsorted(row, [lo, lo + 500]))) for lo in cuts]
    size = len(used) + votes.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(share / (1 - share))
    penalty = np.concatenate([np.full(len(used), decay[0]), np.full(votes.shape[1], decay[1]), [0.0]])
    for t in range(1, rounds + 1):
        linear = flags @ w[len(used):-1] + w[-1]
        grad = np.zeros(size)
        for lo, hi, own in runs:
            linear[lo:hi] += np.bincount(row[own] - lo, w[slot[own]] * value[own], hi - lo)
        error = 1 / (1 + np.exp(-np.clip(linear, -40, 40))) - target
        for _, _, own in runs:
            grad[:len(used)] += np.bincount(slot[own], error[row[own]] * value[own], len(used))
        grad[len(used):] = [*(error @ flags), error.sum()]
        grad = grad / n + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    out = np.zeros(DIMS + votes.shape[1] + 1)
    out[used], out[DIMS:] = w[:len(used)], w[len(used):]
    return out


def sample_sizes(size, max_rows):
    """Rows to take of each kind: ``SHARES`` of ``max_rows``, or more where a kind has less than its share."""
    most = {kind: share * max_rows for kind, share in SHARES.items()}
    take = {kind: min(size[kind], most[kind]) for kind in SHARES}
    for kind, partner in (("known", "marked"), ("marked", "known")):
        take[kind] = min(size[kind], most["known"] + most["marked"] - take[partner])
    if take["known"] + take["marked"] < most["other"]:  # hardly anything else to learn from
        take["other"] = min(size["other"], max_rows - take["known"] - take["marked"])
    return take


def learn_weights(docs: DataFrame, labels: DataFrame, learn, id_col, text_col, label_id, label_col, max_rows):
    """(weights, label model) from the rows where ``learn`` holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learn.alias("learn")).filter("learn")
    table = lexicon_table()

    def vote(batches):
        for batch in batches:
            parts = [pack(votes_of(words, first, table)) for words, first, _ in parsed(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "pick": batch.column("pick"), "pattern": pa.array(np.concatenate(parts) if parts else [], pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    pick = F.xxhash64("id", "text")
    voted = rows.select("id", "text", pick.alias("pick")).mapInArrow(vote, f"id {kind}, pick long, pattern long")
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("gold")).dropna().groupBy("id").agg(F.max("gold").alias("gold"))
    voted = cut_lineage(voted.join(known, "id", "left").select("pick", "pattern", F.coalesce("gold", F.lit(-1)).alias("gold")))
    counted = voted.groupBy("pattern", "gold").agg(F.count("*").alias("n")).toPandas()
    votes, gold = unpack(counted["pattern"].to_numpy(dtype=np.int64)), counted["gold"].to_numpy()
    model = LabelModel(votes, gold, counted["n"].to_numpy(dtype=float))
    # a bounded sample with the same shares at every size; what known or marked rows do not fill goes to the other of the two
    kinds = {"known": gold >= 0, "marked": (gold < 0) & votes.any(axis=1), "other": (gold < 0) & ~votes.any(axis=1)}
    size = {kind_of: float(counted["n"][rows_of].sum()) for kind_of, rows_of in kinds.items()}
    rates = {kind_of: take / max(size[kind_of], 1.0) for kind_of, take in sample_sizes(size, max_rows).items()}
    rate = F.when(F.col("gold") >= 0, F.lit(rates["known"])).when(F.col("pattern") != 0, rates["marked"]).otherwise(rates["other"])
    chosen = voted.filter(draw("pick") < rate).groupBy("pick").agg(F.max("pattern").alias("pattern"), F.max("gold").alias("gold"))

    def features_of(batches):
        for batch in batches:
            slots, values, sizes = [], [], [np.zeros(1, np.int64)]
            for _, first, made in parsed(batch.column("text")):
                slot, value, at = features(first, made)
                slots.append(slot)
                values.append(value)
                sizes.append(np.diff(at))
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            yield pa.RecordBatch.from_arrays([
                batch.column("pick"), pa.ListArray.from_arrays(ends, flat(slots, pa.int32())), pa.ListArray.from_arrays(ends, flat(values, pa.float32())),
            ], ["pick", "slot", "value"])

    # about max_rows picks at most, so they go to the texts and no text is shuffled for the choice
    chosen = F.broadcast(cut_lineage(chosen))
    texts = rows.select(pick.alias("pick"), "text").join(chosen.select("pick"), "pick", "left_semi").dropDuplicates(["pick"])
    sample = texts.mapInArrow(features_of, "pick long, slot array<int>, value array<float>").join(chosen, "pick").toArrow()
    if sample.num_rows == 0:
        flags = np.vstack([np.eye(len(NAMES), dtype=bool), np.zeros((1, len(NAMES)), bool)])
        none = np.zeros(0, np.int64)
        return train(none, none.astype(float), np.zeros(len(flags) + 1, np.int64), flags, np.array([0.8] * len(NAMES) + [0.05])), model
    lists = sample.column("slot").combine_chunks()
    at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
    votes, gold = unpack(np.asarray(sample.column("pattern"))), np.asarray(sample.column("gold"))
    target = np.where(gold >= 0, gold, model.posterior(votes))
    slot, value = np.asarray(lists.flatten()), np.asarray(sample.column("value").combine_chunks().flatten())
    return train(slot, value, at, votes, target), model


def row_scores(column, weights, table):
    out = []
    for words, first, slots in parsed(column):
        out.append(1 / (1 + np.exp(-np.clip(margins(weights, first, slots, votes_of(words, first, table)), -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", text_col="text", label_id="doc_id", label_col="toxic",
                   max_rows=8_000) -> DataFrame:
    """One row per document: id, learn (the condition), score. Learns only from rows where ``learn`` holds."""
    weights, _ = learn_weights(docs, labels, learn, id_col, text_col, label_id, label_col, max_rows)
    shared, table = docs.sparkSession.sparkContext.broadcast(weights), lexicon_table()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "learn": batch.column("learn"), "score": pa.array(row_scores(batch.column("text"), shared.value, table), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), learn.alias("learn"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {kind}, learn boolean, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, learn, threshold=0.3, id_col="doc_id", text_col="text", label_id="doc_id",
               label_col="toxic", max_rows=8_000) -> DataFrame:
    """The documents that score below the threshold, all columns as they are."""
    weights, _ = learn_weights(docs, labels, learn, id_col, text_col, label_id, label_col, max_rows)
    shared, table = docs.sparkSession.sparkContext.broadcast(weights), lexicon_table()

    def keep(batches):
        for batch in batches:
            scores = row_scores(batch.column(batch.schema.get_field_index(text_col)), shared.value, table)
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
