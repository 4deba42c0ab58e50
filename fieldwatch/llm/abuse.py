"""Abusive, hateful or sexual wording: Levenshtein automata over a lexicon trie, then scores of the words around each match."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.lexicon import AMBIGUOUS, PATTERNS, SOBER, STRONG, WEAK

OUT = "doc_id long, source string, score double, category string, matches int, quoted boolean"

#: Letters that look alike, digits and signs that stand for letters, signs that hide one.
ALIKE = str.maketrans("аеорсухіјѕԁһӏκονρτυαεικӓёβмтнвкАЕОРСУХІЈЅТНВМК", "aeopcyxijsdhlkovptuaeikaebmthbkaeopcyxijsthbmk")
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "£": "l", "|": "il"}
HIDES = "*#-_%.+?~=·•"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e"

#: What a window is scored by, and the weights that labelled samples only adjust.
FEATURES = ["always", "strong", "near_long", "near_short", "weak", "insult", "threat", "hate", "sexual", "framed", "addressed", "sober", "quoted"]
PRIOR = (-4.0, 6.0, 4.6, 2.0, 0.3, 7.0, 7.0, 7.0, 7.0, 3.0, 0.8, -2.5, 0.0)


@dataclass(frozen=True)
class AbuseRule:
    """Settings of the score."""

    edits_from: int = 4  # lexicon words so long may have one wrong, missing, additional or exchanged letter
    long_from: int = 7  # in shorter ones that counts for little without a context that is abusive
    two_edits_from: int = 11
    window: int = 14  # words on either side that are context
    close: int = 6  # words on either side that make its sense sober
    threshold: float = 0.8
    cache: int = 400_000  # distinct written forms a task remembers
    most_samples: int = 100_000  # labelled rows that the weights are fitted to
    ridge: float = 2.0  # pull of the weights towards ``PRIOR``
    word_vocabulary: str = "/opt/tokenizers/word_bpe_49k.json"  # public vocabularies: their whole words are no misspellings
    byte_vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


class Automaton:
    """Levenshtein automata of all lexicon words at once: a trie whose nodes are walked with a count of edits.

    An edit is a wrong, missing or additional letter, or two neighbours exchanged. A state is the set of (node, edits, letter still
    owed by an exchange) that a beginning of a form can be at; states and steps are made when first needed and kept, so that a
    form costs one lookup a letter. ``limit_of`` gives the edits that a word may have.
    """

    def __init__(self, words: list[str], limit_of, most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.limit: list[int] = [-1]  # the most edits of any word below the node
        self.allowed = {w: limit_of(w) for w in words}
        for w in words:
            node = 0
            path = [0]
            for ch in w:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.limit.append(-1)
                node = self.children[node][ch]
                path.append(node)
            self.word[node] = w
            for n in path:
                self.limit[n] = max(self.limit[n], self.allowed[w])
        self.most_states = most_states
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.state: list[frozenset] = []
        self.told: list[tuple[int, str] | None] = []
        self.step: dict[tuple[int, str], int] = {}
        self._enter({(0, ""): 0} if self.limit[0] >= 0 else {})

    def _enter(self, at: dict[tuple[int, str], int]) -> int:
        """The number of a state; letters that the form leaves out are skipped here."""
        todo = list(at)
        while todo:
            node, owed = todo.pop()
            e = at[node, owed]
            if owed:
                continue
            for child in self.children[node].values():
                if e < self.limit[child] and at.get((child, ""), 9) > e + 1:
                    at[child, ""] = e + 1
                    todo.append((child, ""))
        key = frozenset((n, w, e) for (n, w), e in at.items())
        if key not in self.number:
            self.number[key] = len(self.state)
            self.state.append(key)
            ends = [(e, -len(self.word[n]), self.word[n]) for n, w, e in key if not w and self.word[n] and e <= self.allowed[self.word[n]]]
            self.told.append((min(ends)[0], min(ends)[2]) if ends else None)
        return self.number[key]

    def _next(self, s: int, c: str) -> int:
        at: dict[tuple[int, str], int] = {}

        def put(node: int, owed: str, e: int) -> None:
            if e <= self.limit[node] and at.get((node, owed), 9) > e:
                at[node, owed] = e

        for node, owed, e in self.state[s]:
            if owed:
                if c == owed:
                    put(node, "", e)
                continue
            put(node, "", e + 1)
            for ch, child in self.children[node].items():
                put(child, "", e + (ch != c))
                if ch != c and c in self.children[child]:
                    put(self.children[child][c], ch, e + 1)
        return self._enter(at)

    def find(self, form: str) -> tuple[int, str] | None:
        """(edits, word) of the nearest word, of equally near ones the longest; None beyond the limits."""
        if len(self.state) > self.most_states:
            self._forget()
        s = 0
        for c in form:
            n = self.step.get((s, c))
            if n is None:
                n = self.step[s, c] = self._next(s, c)
            s = n
            if not self.state[s]:
                return None
        return self.told[s]

    def hidden(self, form: str) -> str | None:
        """The first word of equal length that a form with signs in place of letters can stand for."""
        stack = [(0, 0)]
        n = len(form)
        while stack:
            node, i = stack.pop()
            if i == n:
                if self.word[node]:
                    return self.word[node]
                continue
            c = form[i]
            if c in HIDES:
                stack += [(child, i + 1) for child in self.children[node].values()]
            else:
                stack += [(self.children[node][ch], i + 1) for ch in c + STANDS_FOR.get(c, "") if ch in self.children[node]]
        return None


def _lexicon() -> tuple[frozenset, frozenset, dict[str, str]]:
    unsure = set(AMBIGUOUS.split())
    category = {w: c for c, text in STRONG.items() for w in text.split()}
    strong = frozenset(w for w in category if w not in unsure)
    weak = frozenset(WEAK.split()) | unsure
    return strong, weak - strong, category


def _limit(rule: AbuseRule):
    return lambda w: 2 if len(w) >= rule.two_edits_from else 1 if len(w) >= rule.edits_from else 0


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower().replace("ß", "ss")


def real_words(rule: AbuseRule = AbuseRule()) -> frozenset[str]:
    """Words of the public vocabularies that a lexicon word is few edits from; they are no misspellings of it."""
    with open(rule.word_vocabulary, encoding="utf-8") as f:
        whole = {w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
    with open(rule.byte_vocabulary, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            if token.startswith(" "):
                whole.add(token[1:])
    strong, weak, _ = _lexicon()
    automaton = Automaton(sorted(strong | weak), _limit(rule))
    bare = {_bare(w) for w in whole if w.isalpha() and len(w) >= 3}
    return frozenset(w for w in bare if w not in strong | weak and automaton.find(w))


_EDGE = "\"'“”„«»‚‘’‹›()[]{}<>,;:.?¶…"
_REPEAT = re.compile(r"(.)\1{2,}")
_SPELLED = re.compile(r"(?:[^\W_][-_.*+~·•]){2,}[^\W_]")
NEAR = "\x02"
_PARTS = re.compile(r"[-_/'’<>,.;:()\[\]]+")


def visible(text: str) -> str:
    """Text without invisible characters."""
    for sign in INVISIBLE:
        if sign in text:
            text = text.replace(sign, "")
    return text


def level(chunk: str) -> str:
    """A written form without case, accents, invisible and look-alike letters, or marks at its edges."""
    if not chunk.isascii():
        if "Ã" in chunk or "â€" in chunk:
            try:
                chunk = chunk.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        chunk = unicodedata.normalize("NFKC", visible(chunk)).translate(ALIKE)
        chunk = "".join(c for c in unicodedata.normalize("NFKD", chunk) if not unicodedata.combining(c))
    return chunk.lower().strip(_EDGE).rstrip("!").replace("ß", "ss")


class Matcher:
    """Lexicon words behind written forms, remembered by form. ``real``: words that are no misspellings."""

    def __init__(self, rule: AbuseRule, real: frozenset[str], weights: tuple[float, ...] = PRIOR):
        self.rule, self.real, self.weights = rule, real, weights
        self.strong, self.weak, self.category = _lexicon()
        self.known = self.strong | self.weak
        self.automaton = Automaton(sorted(self.known), _limit(rule))
        self.clean: dict[str, list[str]] = {}
        self.hit: dict[str, list[str]] = {}

    def word(self, form: str) -> str | None:
        """The lexicon word that one levelled form stands for; a misspelt one comes with a mark before it."""
        if form in self.known:
            return form
        n = len(form)
        letters = sum(c.isalpha() for c in form)
        if n < 3 or letters < 1 or letters * 2 < n - 1 and any(c in HIDES for c in form):
            return None
        if letters < 2 and (n < 4 or any(c not in STANDS_FOR and not c.isalpha() for c in form)):
            return None
        if letters < n:  # something stands for letters: nothing else may differ
            if form[0] in HIDES or not form[-1].isalnum() and form[-1] not in HIDES:
                return None
            return self.automaton.hidden(form)
        if _REPEAT.search(form):
            for keep in (r"\1", r"\1\1"):
                once = _REPEAT.sub(keep, form)
                if once in self.known:
                    return once
        if form in self.real:
            return None
        found = self.automaton.find(form)
        return NEAR + found[1] if found else None

    def read(self, chunk: str) -> list[str]:
        """Levelled words of a chunk between blanks, lexicon words in place of their written forms."""
        flat = level(re.sub(r"<[^<>]*>", " ", chunk) if "<" in chunk else chunk)
        out = []
        for piece in flat.split():
            piece = piece.strip(_EDGE)
            if not piece:
                continue
            if _SPELLED.fullmatch(piece):
                piece = re.sub(r"[-_.*+~·•]", "", piece)
            w = self.word(piece)
            out += [w] if w else [self.word(p) or p for p in _PARTS.split(piece) if p]
        return out

    def suspicious(self, chunks: Iterable[str]) -> bool:
        """TRUE if any chunk holds a lexicon word; new chunks are read once and remembered."""
        if len(self.clean) + len(self.hit) > self.rule.cache:
            self.clean.clear()
            self.hit.clear()
        clean, found = self.clean, False
        for c in [c for c in chunks if c not in clean]:
            found |= self.hot(c)
        return found

    def hot(self, c: str) -> bool:
        """TRUE if a chunk that is not known as clean holds a lexicon word."""
        if c in self.hit:
            return True
        if c.upper() == c.lower():
            return False  # numbers and signs are many and hide no word
        read = self.read(c)
        if any(w in self.known or w[0] == NEAR for w in read):
            self.hit[c] = read
            return True
        self.clean[c] = read
        return False


_PATTERNS = [(c, re.compile(p), w) for c, p, w in PATTERNS]
_SOBER = re.compile(SOBER)
_ADDRESSED = re.compile(r"\b(?:you|your|yourself|u|du|dich|dir|dein|deine|ihr|euch|tu|toi|te|ton|ta|vous|tú|ti|eres|sois)\b")
#: The word itself, marked, is what somebody is called.
_FRAMED = re.compile(
    r"\b(?:you|u|you are|you re|youre|are you|such|what|listen|called (?:me|him|her|them|us))(?: (?:an?|nothing but an?|just an?|all|such an?|little|\w+ing|\w+y|\w+ed|\w+less|\w+id)){0,3} \x03|\x03 you\b|\byou (?:\w+ ){0,3}\x03"
    r"|\b(?:du|ihr|sie)(?: (?:bist|seid|sind|eine?|\w+[er])){0,3} \x03|\b(?:tu es|vous etes|espece de|sale|pauvre|gros|grosse)(?: \w+)? \x03|\b(?:eres|sois|es|callate|maldit[oa])(?: una?)?(?: \w+)? \x03|\x03 de mierda\b"
)
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n\s*(?=[^\W\d_])")
_HEADER = re.compile(r"(?mi)^.*\b(?:page|seite|página|folio)\s+\d+\s+(?:of|von|sur|de)\s+\d+.*$")
_QUOTES = re.compile("[\"“”„«»‘’]|(?<!\\w)'|'(?!\\w)")
_SPACED = b"\x01\x01\x01"


def _join_spelled(chunks: list[str]) -> list[str]:
    """Single letters in a row, as in a spelled word, joined."""
    out: list[str] = []
    run: list[str] = []
    for c in [*chunks, None]:
        core = c.strip(_EDGE + "!") if c is not None else None
        if core is not None and len(core) == 1 and core.isalpha():
            run.append(core)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        if c is not None:
            out.append(c)
    return out


def windows(text: str | None, m: Matcher) -> Iterator[tuple[int, str | None, list[float]]]:
    """(number of the word, category, features) of every lexicon word of a text, exact or misspelt, with the words around it."""
    if not text:
        return
    if "-\n" in text or "-\r\n" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = visible(text)
    chunks = text.split()
    try:
        spaced = _SPACED in bytes(map(len, chunks))
    except ValueError:  # a chunk of more than 255 characters
        spaced = _SPACED in bytes(min(len(c), 255) for c in chunks)
    if not m.suspicious(set(chunks)) and not spaced:
        return
    if "age " in text or "eite " in text or "gina " in text:
        chunks = _HEADER.sub(" ", text).split()
    chunks = _join_spelled(chunks) if spaced else chunks
    at = [k for k, c in enumerate(chunks) if c not in m.clean and m.hot(c)]
    words: list[str] = []
    marks: list[bool] = []
    hot: list[tuple[int, bool]] = []
    quotes = done = 0
    for k in at:  # only the surroundings of lexicon words are read, far enough for a window of words
        lo, hi = max(done, k - 3 * m.rule.window), min(len(chunks), k + 3 * m.rule.window + 1)
        if lo > done and words:
            words += [""] * m.rule.window  # apart from the surroundings before
            marks += [False] * m.rule.window
        quotes += len(_QUOTES.findall(" ".join(chunks[done:lo])))
        for c in chunks[lo:hi]:
            signs = 0 if c.isalnum() else len(_QUOTES.findall(c))
            for w in m.clean[c] if c in m.clean else m.hit[c] if c in m.hit else m.read(c):
                near = w[0] == NEAR
                w = w[1:] if near else w
                if near or w in m.known:
                    hot.append((len(words), near))
                words.append(w)
                marks.append(quotes % 2 == 1 or signs > 0)
            quotes += signs
        done = max(done, hi)
    for i, near in hot:
        around = " ".join(w for w in words[max(0, i - m.rule.window): i + m.rule.window + 1] if w)
        close = words[max(0, i - m.rule.close): i], words[i + 1: i + m.rule.close + 1]
        found, kind, best = dict.fromkeys(("insult", "threat", "hate", "sexual"), 0.0), None, 0.0
        for c, p, w in _PATTERNS:
            if w > found[c] and p.search(around):
                found[c] = w
                kind, best = (c, w) if w > best else (kind, best)
        strong, long = words[i] in m.strong, len(words[i]) >= m.rule.long_from
        kind = m.category[words[i]] if strong and not best else kind
        yield i, kind, [1.0, float(strong and not near), float(strong and near and long), float(strong and near and not long), float(not strong), *found.values(),
                        float(_FRAMED.search(" ".join([*close[0], "\x03", *close[1]])) is not None), float(_ADDRESSED.search(around) is not None),
                        float(min(2, len(_SOBER.findall(" ".join([*close[0], words[i], *close[1]]))))), float(marks[i])]


def _squash(x: float) -> float:
    return 1 / (1 + np.exp(-x))


def score_text(text: str | None, m: Matcher) -> tuple[float, str | None, int, bool]:
    """Score, category, number of matches and whether all of them stand in quotation marks."""
    best, category, matches, inside, done = 0.0, None, 0, True, -1
    for i, kind, features in windows(text, m):
        value = float(_squash(sum(w * x for w, x in zip(m.weights, features))))
        if value > best:
            best, category = value, kind
        if value >= m.rule.threshold and i > done:
            matches += 1
            inside &= features[-1] > 0
            done = i + m.rule.window
    return best, category, matches, bool(matches) and inside


def fit_weights(samples: list[tuple[str, bool]], m: Matcher) -> tuple[float, ...]:
    """Weights of the features by logistic regression on labelled texts, pulled towards ``PRIOR``; a text counts by its worst window
    under the prior. Wrong labels weigh little, since one text moves the weights little."""
    prior = np.array(PRIOR)
    rows, told = [], []
    for text, bad in samples:
        each = [f for _, _, f in windows(text, m)]
        rows.append(max(each, key=lambda f: float(prior @ f)) if each else [1.0] + [0.0] * (len(FEATURES) - 1))
        told.append(float(bad))
    x, y, w = np.array(rows).reshape(-1, len(FEATURES)), np.array(told), prior.copy()
    for _ in range(50):
        p = _squash(np.clip(x @ w, -30, 30))
        slope = x.T @ (y - p) - m.rule.ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + m.rule.ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(samples: DataFrame, rule: AbuseRule = AbuseRule()) -> tuple[frozenset[str], tuple[float, ...]]:
    """What ``score_documents`` needs from the vocabularies and from labelled rows (text, verdict): real words and weights. At most
    ``most_samples`` rows are fitted; rows without text or verdict are left out, without any the weights are ``PRIOR``."""
    rows = samples.where("text is not null and verdict in ('offensive', 'acceptable')").select("text", "verdict").limit(rule.most_samples).collect()
    real = real_words(rule)
    return real, fit_weights(sorted((r.text, r.verdict == "offensive") for r in rows), Matcher(rule, real))


def _scorer(rule: AbuseRule, broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(rule, *broadcast.value)
        for batch in batches:
            rows = [score_text(t, m) for t in batch.column(2).to_pylist()]
            s, c, n, q = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(c, pa.string()), pa.array(n, pa.int32()), pa.array(q, pa.bool_())],
                                             names=["doc_id", "source", "score", "category", "matches", "quoted"])

    return score


def score_documents(documents: DataFrame, samples: DataFrame | None = None, rule: AbuseRule = AbuseRule()) -> DataFrame:
    """One row for every document of (doc_id, source, text): score 0 to 1, category of the worst passage, passages at or above
    the threshold, and whether all of these stand in quotation marks (as a witness's words do).

    Every lexicon word, exact, disguised or misspelt, is scored with the words around it: abusive turns of phrase, being addressed, sober
    surroundings and quotation marks; the weights are fitted to the labelled ``samples`` (text, verdict) where given.
    Whole texts are read where they lie, without a shuffle; documents of any kind of source cost alike. NULL and empty
    texts have score 0; copies are scored one by one; an empty table gives none. Further columns are not passed on.
    """
    learned = learn(samples, rule) if samples is not None else (real_words(rule), PRIOR)
    broadcast = documents.sparkSession.sparkContext.broadcast(learned)  # bounded by vocabularies and lexicon
    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(_scorer(rule, broadcast), OUT)


def rates_by_source(scores: DataFrame, rule: AbuseRule = AbuseRule()) -> DataFrame:
    """Documents, flagged documents, their rate and the mean score per source (NULL is a source of its own)."""
    flagged = (F.col("score") >= rule.threshold).cast("int")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(flagged).alias("flagged"), F.round(F.avg(flagged), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
