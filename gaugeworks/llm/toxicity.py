"""Toxicity with noisy-channel deobfuscation.

A token of any length with digits, signs or a repeated letter, or letters and signs spelled with gaps, is read as a
lattice: every sign stands for some letters, or for nothing, at a cost, and a run of one letter for one or two of it.
What separates (dots, dashes, slashes, gaps) stands for nothing or for the end of a word.
Viterbi decoding finds the likeliest letters under a character trigram model, whose counts come from the words of all
documents. The restored words are then scored as if they had stood there.
The model is a written table that no task and no driver holds whole: the distinct tokens that need reading are dealt to
groups, each group meets the n-grams that its lattices can ask for by a join, and what a token was read as comes back to
its texts by another. Scoring reads only tokens whose lattice can spell a marker, which loses none.

The score: the words and word beginnings that mark labelled documents have log-odds. Some beginnings tell by how often
other words have them: these have rates a word in toxic and clean texts, and a document's number of such words a
log-likelihood. A document's strongest word, its total and its most telling beginning go through a logistic curve.
Log-odds and rates are counted on three quarters of a sample of labelled documents, each
text once, and the curve is fitted on the last quarter. The sample is the first SAMPLE labelled rows by a hash of the
id, so its size doesn't grow with the input.

Defined results: null and empty texts get the curve's value without any evidence; texts are read whole; without usable
labels every score is 0; of repeated labels for a document the largest counts; labels that are null teach nothing.
Equal texts, repeated rows among them, get equal scores; rows of the sample that tie in its hash are taken by id; an
empty table gives no rows. score_toxicity() replaces columns named score and predicted and keeps all others.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, held_out, materialize, table

SAMPLE = 20_000
THRESHOLD = 0.3
HELD_WORDS = 200_000
PREFIXES = (4, 5)
#: A beginning has a rate of its own from so many words in toxic texts on; what its rate can say at most, in nats.
LEAST_WORDS, MOST_NATS = 5, 20.0

# What signs stand for, and the costs of the channel, in nats.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
SIGN_COST, SIGN_DROP_COST, DROP_COST, SPLIT_COST, FOLD_COST, DOUBLE_COST = 0.7, 12.0, 0.5, 0.5, 0.3, 0.8
#: What falling back from two characters to one costs.
BACKOFF = math.log(0.2)
#: Readings of a token that end in other letters count too if they are this near to the best one, in nats.
NEAR_BEST, READINGS = 4.0, 5

LETTERS = re.compile(r"[^\W\d_]+")
#: Three or more single letters or signs with white space between them.
ONE = r"(?:[^\W_]|[@$!|+(€£¡*#])"
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?:[.,;:_-]?\s+{ONE}){{2,}}(?![^\W_])")
RUNS = re.compile(r"(.)\1*")
REPEAT = re.compile(r"([^\W\d_])\1")
EDGE = " \t\r\n.,;:?\"'()[]{}<>«»“”„…%&"
#: Bits of a character in the number of an n-gram; trigrams lie above all pairs, as no word holds characters below the blank.
BITS = 21
HELD_GRAMS = 500_000
#: Distinct tokens decoded as one group, with the n-grams that they ask for.
GROUP = 8192
UNSEEN = math.log(1e-4)


def gram_number(gram: str) -> int:
    k = 0
    for c in gram:
        k = k << BITS | ord(c)
    return k


class Characters:
    """Log-probabilities of a character after two others and after one: the n-grams that a group of tokens can ask for as
    two sorted arrays, and the ones that were asked for lately in a table."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.logs, self.memo = grams[order], logs[order], {}

    def look_up(self, gram: str) -> float | None:
        k = gram_number(gram)
        at = int(np.searchsorted(self.grams, np.int64(k)))
        return float(self.logs[at]) if at < len(self.grams) and self.grams[at] == k else None

    def log_p(self, state: str, c: str) -> float:
        """Of c after the two characters of state; after one, at a discount, where the trigram was never seen."""
        gram = state + c
        if (v := self.memo.get(gram)) is None:
            if len(self.memo) > HELD_GRAMS:
                self.memo.clear()
            if (v := self.look_up(gram)) is None and (v := self.look_up(gram[1:])) is None:
                v = UNSEEN
            self.memo[gram] = v
        return v


class Asked:
    """Stands in for a model and notes the n-grams that decoding asks for: all of them, as no state is given up."""

    def __init__(self):
        self.grams: set[int] = set()

    def log_p(self, state: str, c: str) -> float:
        self.grams.update((gram_number(state + c), gram_number(state[1:] + c)))
        return 0.0


class CharacterTable:
    """The model of the whole corpus: a written table (gram, p)."""

    unseen = UNSEEN

    def __init__(self, table: DataFrame):
        self.table = table

    @property
    def grams(self) -> range:
        """The places of its n-grams, one a row."""
        return range(self.table.count())

    def log_p(self, state: str, c: str) -> float:
        """Of one n-gram, by a job of its own; decoding joins instead."""
        asked = Asked()
        asked.log_p(state, c)
        found = self.table.where(F.col("gram").isin(*asked.grams)).toArrow()
        return Characters(found.column("gram").to_numpy(), found.column("p").to_numpy()).log_p(state, c)


def letters_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letters among code points, and for each code point its letter's number from 1 on, 0 for all else."""
    found, at = np.unique(codes, return_inverse=True)
    is_letter = np.array([bool(LETTERS.fullmatch(chr(c))) for c in found], bool)
    number = np.where(is_letter, np.cumsum(is_letter), 0)
    return found[is_letter], number[at]


def trigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the trigrams of all words, each word led by two blanks and ended by one."""
    codes = np.frombuffer(" ".join(["", "", *texts, "", ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, c = letters_of(codes)
    before, after = c[1:-1], c[2:]  # the character before each place from 2 on, and the one there
    first = np.where(before > 0, c[:-2], 0)
    ours = (after > 0) | (before > 0)
    base = len(letters) + 1
    key = (first[ours].astype(np.int64) * base + before[ours]) * base + after[ours]
    if base**3 <= 1 << 22:
        n = np.bincount(key, minlength=base**3)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    code = np.concatenate([[ord(" ")], letters]).astype(np.int64)
    return code[key // base**2] << 2 * BITS | code[key // base % base] << BITS | code[key % base], n


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (gram, n): character trigrams of each batch's words."""
    for b in batches:
        grams, n = trigrams_of([t.lower() for t in b.column("text").to_pylist() if t])
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])


def learn_characters(docs: DataFrame) -> CharacterTable:
    """Counts and context totals are those of all documents, whatever the script; the model grows with their distinct
    n-grams, which are far fewer than their words."""
    counted = docs.select("text").mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    three = materialize(counted, "trigrams")
    two = three.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("gram")).agg(F.sum("n").alias("n"))

    def logs(grams: DataFrame, penalty: float) -> DataFrame:
        led = grams.withColumn("led", F.shiftright("gram", BITS))
        return led.join(led.groupBy("led").agg(F.sum("n").alias("all")), "led").select("gram", (F.log(F.col("n") / F.col("all")) + penalty).cast("float").alias("p"))

    model = CharacterTable(materialize(logs(three, 0.0).unionAll(logs(two, BACKOFF)), "characters"))
    discard(three)
    return model


def lattice(token: str, split: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one sign, the strings that it may stand for and their costs. With split, a separator may also
    end a word."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run, i = j - i, j
        if c.isalpha():
            options = [(c, 0.0)] if run == 1 else [(c, DOUBLE_COST), (c * 2, 0.0)] if run == 2 else [(c, FOLD_COST), (c * 2, DOUBLE_COST)]
        elif c in SIGNS:
            options = [(s, SIGN_COST) for s in SIGNS[c]] + [("", SIGN_DROP_COST)]
            options += [(s * 2, SIGN_COST + DOUBLE_COST) for s in SIGNS[c]] if run > 1 else []
        else:
            options = [("", DROP_COST), (" ", SPLIT_COST)] if split else [("", DROP_COST)]
        out.append(options)
    return out


def decode(token: str, model: Characters, split: bool = False) -> list[str]:
    """The likeliest letters behind a token, the best first: Viterbi over the last two letters. With split, words have
    blanks between them. A path is a chain of links, so that the work is linear in the token's length."""
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    log_p = model.log_p
    for options in lattice(token, split):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for letters, cost in options:
                s, now = state, score - cost
                if letters == " ":
                    if s == "  ":
                        continue
                    now, s = now + log_p(s, " "), "  "
                else:
                    for c in letters:
                        now += log_p(s, c)
                        s = s[1] + c
                if s not in nxt or now > nxt[s][0]:
                    nxt[s] = (now, (path, letters) if letters else path)
        best = nxt
    ends = sorted(((score + (log_p(s, " ") if s != "  " else 0.0), s) for s, (score, _) in best.items()), reverse=True)[:READINGS]
    words = []
    for score, s in ends:
        if score >= ends[0][0] - NEAR_BEST:
            path, letters = best[s][1], []
            while path:
                path, last = path
                letters.append(last)
            words.append("".join(reversed(letters)))
    return [w for w in words if w]


def is_plain(core: str) -> bool:
    """Letters alone, none of them repeated: read as it stands. Any other token may be a disguise."""
    return core.isalpha() and not REPEAT.search(core)


def words_in(token: str, model: Characters | Asked) -> list[str]:
    """The words of a token, restored if it looks obfuscated: it has a sign, a digit, a gap or a repeated letter."""
    core = token.strip(EDGE)
    if is_plain(core):
        return [core]
    found = LETTERS.findall(core)
    core = core.rstrip("!*|+#")
    if any(c.isalpha() or c in SIGNS for c in core):
        found += decode(core, model)
        if not all(c.isalpha() or c in SIGNS for c in core):
            found += [w for words in decode(core, model, split=True) for w in words.split()]
    return found


def spaced_words(text: str) -> list[str]:
    """Letters and signs spelled with white space between them, a blank for each gap; words_in() reads them."""
    return [" ".join(m[0].split()) for m in SPACED.finditer(text)]


def tokens_of(text: str | None) -> set[str]:
    if not text:
        return set()
    low = text.lower()
    split = low.split()
    tokens = set(split)
    if len([t for t in split if len(t) <= 2]) >= 3:
        tokens.update(spaced_words(low))
    return tokens


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def disguises(texts: DataFrame) -> DataFrame:
    """(key, text) -> (key, token): each text's tokens that are not plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[t for t in tokens_of(text) if not is_plain(t.strip(EDGE))] for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.list_(pa.string()))], ["key", "tokens"])

    found = texts.select("key", "text").mapInArrow(run, "key string, tokens array<string>")
    return found.select("key", F.explode("tokens").alias("token")).distinct()


def notes_of(texts: DataFrame, sent) -> DataFrame:
    """(key, text) -> (key, n, odds, begins, tokens), no text in it: what each text's plain tokens say to the scorer in
    sent, and the tokens that may say more once they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            notes = [scorer.note(text) for text in b.column("text").to_pylist()]
            types = pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([n[i] for n in notes], t) for i, t in enumerate(types))], ["key", "n", "odds", "begins", "tokens"])

    return texts.select("key", "text").mapInArrow(run, "key string, n long, odds array<double>, begins array<string>, tokens array<string>")


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, part) -> (part, gram): the n-grams that reading the tokens can ask for."""
    for b in batches:
        asked: dict[int, Asked] = {}
        for token, part in zip(b.column("token").to_pylist(), b.column("part").to_pylist(), strict=True):
            words_in(token, asked.setdefault(part, Asked()))
        parts = np.repeat(np.array(list(asked), np.int64), [len(a.grams) for a in asked.values()])
        grams = np.array([g for a in asked.values() for g in a.grams], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(grams, pa.int64())], ["part", "gram"])


def read_part(tokens: pa.Table, grams: pa.Table) -> pa.Table:
    """The distinct words behind each token of a group, under the n-grams that the group asked for."""
    model = Characters(grams.column("gram").to_numpy(), grams.column("p").to_numpy())
    tokens = tokens.column("token").combine_chunks()
    return pa.table({"token": tokens, "words": pa.array([sorted(set(words_in(t, model))) for t in tokens.to_pylist()], pa.list_(pa.string()))})


def read_tokens(tokens: DataFrame, model: CharacterTable) -> DataFrame:
    """(token), distinct -> (token, words). A group holds about GROUP tokens and what they ask for, however large the
    model is; their number follows the tokens."""
    tokens = materialize(tokens, "tokens")
    parts = tokens.count() // GROUP + 1
    tokens = tokens.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)))
    asked = tokens.repartition("part").mapInArrow(ask, "part long, gram long").distinct().join(model.table, "gram")
    return tokens.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(read_part, "token string, words array<string>")


def readings(pairs: DataFrame, model: CharacterTable, sent=None) -> DataFrame:
    """(key, token) -> (key, read: array of (token, words)): what the disguised tokens of a text were read as, where there are
    any. With a scorer's parts in sent, only words that mark. The key is a digest of the text, so copies are read once."""
    pairs = materialize(pairs.distinct(), "disguises")
    words = read_tokens(pairs.select("token").distinct(), model)
    if sent:

        def marking(lists: pa.Array) -> pa.Array:
            scorer = Scorer(*sent.value)
            return pa.array([[w for w in ws if any(scorer.weight_of([w]))] for ws in lists.to_pylist()], pa.list_(pa.string()))

        words = words.withColumn("words", F.arrow_udf(marking, "array<string>")("words"))
    words = materialize(words.where(F.size("words") > 0), "readings")
    read = pairs.join(words, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("token", "words"))).alias("read"))
    read = materialize(read, "read")
    discard(pairs)
    discard(words)
    return read


def known_words(read: list | None) -> dict[str, list[str]]:
    return {r["token"]: r["words"] for r in read or ()}


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, read) -> (feature, marked, clean): texts of each class with each word and beginning; for #beginning
    its distinct words in all texts, and for # all distinct words."""
    marked, clean = Counter(), Counter()
    for b in batches:
        for text, toxic, read in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "read")), strict=True):
            tokens, counts, known = tokens_of(text), marked if toxic else clean, known_words(read)
            had = []
            for t in tokens:
                core = t.strip(EDGE)
                had += {f for w in ([core] if is_plain(core) else known.get(t, ())) for f in features_of(w)}
            counts.update(set(had))
            counts.update(f"#{f}" for f in had if f[0] != "=")
            counts["#"] += len(tokens)
    every = list(marked | clean)
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([marked[f] for f in every], pa.int64()), pa.array([clean[f] for f in every], pa.int64())], ["feature", "marked", "clean"])


def folded(word: str) -> str:
    """With one letter for each run of it: all readings of a word of letters have the same."""
    return RUNS.sub(r"\1", word) if REPEAT.search(word) else word


class Scorer:
    """Scores texts by their plain tokens and by what the others were read as."""

    #: Stands for the weight of a token that has to be read.
    READ = "read"

    def __init__(self, weights: dict[str, float], rates: dict[str, tuple[float, float]], curve: tuple[float, ...] | None):
        self.weights, self.rates, self.curve, self.memo = weights, rates, curve, {}
        self.whole = {f[1:] for f in weights if f[0] == "="}
        self.begins = {f for f in [*weights, *rates] if f[0] != "="}
        self.stems = {f[:n] for f in self.whole | self.begins for n in range(len(f) + 1)}
        self.folded = {folded(f) for f in self.begins}, {folded(f) for f in self.whole}
        self.sizes = sorted({len(f) for f in self.folded[0]}, reverse=True)

    def may_mark(self, core: str) -> bool:
        """Of letters: no reading of them can mark if they don't begin as a marker does, runs of a letter aside."""
        core = folded(core)
        return core in self.folded[1] or any(core[:n] in self.folded[0] for n in self.sizes)

    def can_spell(self, token: str) -> bool:
        """Whether some path of the token's lattice spells a marker, at any cost: a word that begins as one or is one."""
        core = token.strip(EDGE)
        if core.isalpha():
            return self.may_mark(core)
        if any(self.weight_of(LETTERS.findall(core))):
            return True
        core = core.rstrip("!*|+#")
        begun, split = {""}, not all(c.isalpha() or c in SIGNS for c in core)
        for options in lattice(core, split):
            nxt = {""} if any(letters == " " for letters, _ in options) else set()
            for stem in begun:
                for letters, _ in options:
                    if letters == " ":
                        if stem in self.whole:
                            return True
                        continue
                    now = stem
                    for c in letters:
                        now += c
                        if now in self.begins:
                            return True
                    if now in self.stems:
                        nxt.add(now)
            begun = nxt
            if not begun and not split:
                return False
        return any(stem in self.whole for stem in begun)

    def weight_of(self, words: list[str]) -> tuple[float, tuple[str, ...]]:
        """The words' highest log-odds and their beginnings that have rates."""
        features = {f for word in words for f in features_of(word)}
        return max((self.weights.get(f, 0.0) for f in features), default=0.0), tuple(f for f in features if f in self.rates)

    def weigh(self, token: str) -> tuple | str:
        """The weight of a plain token, empty if it has none; READ for another that may mark."""
        if len(self.memo) > HELD_WORDS:
            self.memo.clear()
        core = token.strip(EDGE)
        if not is_plain(core):
            w = self.READ if self.can_spell(token) else ()
        elif not self.may_mark(core) or not any(w := self.weight_of([core])):
            w = ()
        self.memo[token] = w
        return w

    def note(self, text: str | None) -> tuple[int, list[float], list[str], list[str]]:
        """The number of distinct tokens, the plain ones' log-odds and beginnings with rates, and the tokens to read."""
        odds, begins, read, known = [], [], [], self.memo.get
        tokens = tokens_of(text)
        for t in tokens:
            if w := (self.weigh(t) if (k := known(t)) is None else k):
                if w is self.READ:
                    read.append(t)
                    continue
                if w[0]:
                    odds.append(w[0])
                begins += w[1]
        return len(tokens), odds, begins, read

    def evidence(self, n: int, odds: list[float], begins: list[str], read: list | None) -> tuple[float, float, float]:
        """The strongest token's log-odds, the logarithm of the total, and what the most telling beginning says: the
        log-likelihood of its number of distinct words at the rate of toxic texts against the rate of clean ones."""
        found, begun = list(odds), Counter(begins)
        for words in known_words(read).values():
            more, also = self.weight_of(words)
            if more:
                found.append(more)
            begun.update(also)
        told = max((k * self.rates[f][0] - n * self.rates[f][1] for f, k in begun.items()), default=0.0)
        return max(found, default=0.0), math.log1p(math.fsum(found)), max(0.0, min(MOST_NATS, told))

    def score(self, n: int = 0, odds: list[float] = (), begins: list[str] = (), read: list | None = None) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + math.fsum(b * x for b, x in zip(self.curve[1:], self.evidence(n, odds, begins, read), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's method."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.diag([1e-3, *[1.0] * x.shape[1]]) * len(x) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def log_odds(marked, clean, n_marked: int, n_clean: int):
    """Smoothed so that a feature seen once or twice stays near 0."""
    prior = n_marked / (n_marked + n_clean)
    return F.log(((marked + prior) / (n_marked + 1.0)) / ((clean + (1 - prior)) / (n_clean + 1.0)))


def without_top_word(counted: DataFrame) -> DataFrame:
    """Words and beginnings, and of a beginning that one word makes up in toxic texts, only what other words say, if clean
    texts have any: `lose` is not a marker because `loser` is. Adds one_word."""
    c = F.col
    words = counted.where(c("feature").startswith("=")).select(F.substring("feature", 2, 2**30).alias("w"), "marked", "clean")
    each = words.select(F.explode(F.array(*(F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in PREFIXES))).alias("feature"), F.struct("marked", "clean", "w").alias("word"))
    tops = each.where("feature IS NOT NULL").groupBy("feature").agg(F.max("word").alias("top"))
    rows = counted.join(tops, "feature", "left").withColumn("one_word", F.coalesce(c("top.marked") * 2 > c("marked"), F.lit(False)))
    less = c("one_word") & (c("clean") > c("top.clean"))
    take = lambda n: F.when(less, c(n) - c(f"top.{n}")).otherwise(c(n)).alias(n)
    return rows.select("feature", "one_word", take("marked"), take("clean"))


def word_rates(counted: DataFrame, one_word: DataFrame) -> dict[str, tuple[float, float]]:
    """Beginnings whose words are more frequent in toxic texts: the logarithm of the ratio of the two rates a word, and
    their difference. Each rate is smoothed by one word at the common rate. Beginnings of one word alone have none."""
    all_ = counted.where("feature = '#'").first()
    m, c = F.col("marked"), F.col("clean")
    even = (m + c) / (all_["marked"] + all_["clean"])
    a, b = (m + 1) / (all_["marked"] + 1 / even), (c + 1) / (all_["clean"] + 1 / even)
    rows = counted.where(F.col("feature").startswith("#") & (F.length("feature") > 1) & (m >= LEAST_WORDS)).select(F.substring("feature", 2, 99).alias("f"), F.log(a / b).alias("ratio"), (a - b).alias("more"))
    rows = rows.join(one_word.select(F.col("feature").alias("f")), "f", "left_anti")
    return {r["f"]: (r["ratio"], r["more"]) for r in rows.where("ratio > 1.5").collect()}


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[CharacterTable, dict[str, float], dict[str, tuple[float, float]], tuple[float, ...] | None]:
    """docs (doc_id, text), labels (doc_id, toxic) -> the character model, the markers' log-odds, the beginnings' rates
    and the curve."""
    model = learn_characters(docs)
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = materialize(usable.orderBy(order, "doc_id").limit(sample), "labelled")
    rows = docs.join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rows = materialize(rows.groupBy("text").agg(F.max("toxic").cast("boolean").alias("toxic")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).withColumn("key", text_key()), "sample")
    size = {r["toxic"]: r["count"] for r in rows.where("part < 3").groupBy("toxic").count().collect()}
    if len(size) < 2:
        return model, {}, {}, None
    rows = rows.join(readings(disguises(rows), model), "key", "left")
    counted = rows.where("part < 3").select("text", "toxic", "read").mapInArrow(count_features, "feature string, marked long, clean long")
    counted = materialize(counted.groupBy("feature").agg(F.sum("marked").alias("marked"), F.sum("clean").alias("clean")).where("marked >= 2"), "counted")
    features = without_top_word(counted.where(~F.col("feature").startswith("#")))
    odds = features.where("marked >= 2").withColumn("w", log_odds(F.col("marked"), F.col("clean"), size[True], size[False])).where("w > 1.5")
    weights, rates = {r["feature"]: r["w"] for r in odds.select("feature", "w").collect()}, word_rates(counted, features.where("one_word"))
    sent, name = docs.sparkSession.sparkContext.broadcast((weights, rates, None)), uuid.uuid4().hex

    def evidence(texts: pa.Array, read: pa.Array) -> pa.Array:
        scorer = scorer_for(name, sent)
        return pa.array([list(scorer.evidence(*scorer.note(t)[:3], r)) for t, r in zip(texts.to_pylist(), read.to_pylist(), strict=True)], pa.list_(pa.float64()))

    held = rows.where("part = 3").select("toxic", F.arrow_udf(evidence, "array<double>")("text", "read").alias("x")).collect()
    y = np.array([float(r["toxic"]) for r in held])
    if not len(y) or y.min() == y.max():
        return model, weights, rates, (-4.0, 1.0, 0.0, 0.0)
    return model, weights, rates, fit_curve(np.array([r["x"] for r in held]), y)


#: One scorer for each Python worker and learned model, so that memos live as long as the worker.
_scorers: dict[str, Scorer] = {}


def scorer_for(key: str, sent) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(*sent.value)
    return _scorers[key]


def text_key(text: str = "text") -> Column:
    return F.md5(F.col(text).cast("binary"))


def text_scores(texts: DataFrame, learned, text: str = "text") -> DataFrame:
    """(key, score), a row a distinct text, null aside; the key is text_key(). The markers sent to the executors come from
    SAMPLE labelled texts. A text is looked at once; its notes, not the text, meet the readings of its disguised tokens."""
    model, *parts = learned
    sent, name = texts.sparkSession.sparkContext.broadcast(tuple(parts)), uuid.uuid4().hex
    notes = materialize(notes_of(texts.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(text).alias("text")), sent), "notes")
    read = readings(notes.select("key", F.explode("tokens").alias("token")), model, sent)

    def scores(*columns: pa.Array) -> pa.Array:
        scorer = scorer_for(name, sent)
        return pa.array([scorer.score(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.float64())

    each = notes.drop("tokens").dropDuplicates(["key"]).join(read, "key", "left")
    out = materialize(each.select("key", F.arrow_udf(scores, "double")("n", "odds", "begins", "read").alias("score")), "scores")
    discard(notes)
    discard(read)
    return out


def score_toxicity(df: DataFrame, learned, text: str = "text") -> DataFrame:
    """Adds score and predicted (1 from THRESHOLD on); columns of these names are replaced, all others stay."""
    key, found = f"_key_{uuid.uuid4().hex}", f"_score_{uuid.uuid4().hex}"
    scores = text_scores(df, learned, text).select(F.col("key").alias(key), F.col("score").alias(found))
    joined = df.withColumn(key, text_key(text)).join(scores, key, "left")
    joined = joined.withColumn("score", F.coalesce(found, F.lit(Scorer(*learned[1:]).score()))).drop(key, found)
    return joined.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = learn_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, learned).select("doc_id", held_out().alias("held_out"), "score", "predicted")
