"""Broken prompt and response pairs (problem 5).

Method: the languages of instruction and reply are compared by the posteriors of a character n-gram naive Bayes
model; whether a reply without an end mark breaks off is judged by the smoothed log odds that its last characters end
a text. A naive Bayes of word n-grams tells refusals: listed phrases, which settle it by themselves, give it its first
labels, and it finds what no list has but is worded like them. The models are fitted on all samples and instructions: distinct
texts are counted once, all counts are made in tasks, and only what can decide about a sample travels to the driver.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import strip
from ..runtime import BROADCAST_ROWS, durable, is_small, lookup_skewed
from .columns import forms, tally

#: Distinct texts that a task of the fit has, about.
FIT_PART = 20_000
#: The least odds (natural log) of a reply to be a refusal, and those by n-grams of known refusals alone from which a
#: reply of the sample is relabelled as one.
REFUSAL_ODDS, RELABEL_ODDS = 12.0, 20.0
#: The least odds (natural log) by which a tail that recurs is a closing phrase, before it is seen, and the chances
#: that a clause that begins with it ends there if it is one, and if it is where replies break off.
CLOSING_PRIOR, CLOSING_ENDS, BROKEN_ENDS = -11.0, 0.9, 0.005
#: A place where replies break off by chance may recur too: the chance that a clause ends there, the odds against it in
#: up to CHANCE_AMONG replies; among more it is the likelier in proportion.
CHANCE_ENDS, CHANCE_ODDS, CHANCE_AMONG = 0.5, 1.0, 10_000
#: The weight of the shorter suffix against what is counted of a longer one.
SMOOTHING = 0.2
#: Letters a reply must have for its language to be judged, and the least odds (natural log) against the instruction's.
MIN_LETTERS, MIN_ODDS = 4, 2.0

# Replies that stand for no content, after marks and blanks are taken off and case is folded.
STAND_INS = set("""none null nil na nan n/a empty blank void undefined missing noresponse noreply nooutput noanswer nocontent
nothing emptyresponse emptyreply emptyoutput responseempty noresult notext keineantwort sinrespuesta pasderéponse нетответа
なし 無し 返信なし 空 无 无回复 vide leer vacío""".split())
# Phrases by which a reply declines, per language; they label the first fit.
REFUSALS = regex.compile(
    r"""\b(?:
    (?:can(?:not|['’]?t)|could\s?n['’]t|won['’]t|will\snot|unable\sto|not\sable\sto|refuse\sto|(?:have|need)\sto\sdecline|must\sdecline|decline\sto)
      \b(?!\swait|\sforget|\sbelieve|\sstop|\ssleep).{0,40}\b(?:help|answer|assist|respond|reply|comply|provide|produce|request|message|prompt|generate|create|fulfil|this\sone|discuss|share)
    | (?:must|have\sto|will|need\sto)\s(?:pass|decline|refuse)\b | not\ssomething\si\s(?:can|could|will)\s(?:respond|answer|help|reply|do)
    | against\smy\s(?:guidelines|polic|rules|principles) | not\s(?:allowed|permitted)\sto\b
    | muss\sich\sablehnen | darauf\skann\sich\snicht | kann\sich\s(?:leider\s)?nicht\s(?:antworten|helfen|beantworten) | darf\sich\snicht | antwort\sist\smir\s.{0,12}nicht\smöglich | (?:verweigere|lehne\s.{0,20}ab\b)
    | gegen\smeine\s(?:richtlinien|regeln)
    | ne\s(?:peux|puis)\spas\s(?:répondre|vous\said|aider|traiter) | dois\s(?:refuser|décliner) | m['’]est\simpossible | m['’]interdit | contraire\sà\smes
    | no\spuedo\s(?:ayudar|responder|contestar|atender) | debo\s(?:rechazar|declinar) | no\svoy\sa\s(?:dar|responder|contestar) | no\sme\sestá\spermitido | va\scontra\smis
    | не\sмогу\s(?:ответить|помочь|отвечать|помогать|выполнить) | придётся\sотказаться | (?:вынужден|должен)\sотказ | не\sвправе | отказываюсь | против(?:оречит)?\sмои[хм]\sправил
    )|お答えできません|お手伝いすることができません|差し控え|お断り|お応えできません|回答できません|対応できません|できかねます|无法(?:回答|回复|协助|提供)|不能(?:回答|回复|协助)|拒绝回答""",
    regex.X | regex.I,
)
_LABEL = regex.compile(r"^\s*(?:[*_>\"'«„“-]*\s*)?(?:reply|answer|response|output|emoji|antwort|réponse|respuesta|ответ|返信|a|r|q)\s*[:：]", regex.I)
_ARROW = regex.compile(r"^\s*[-=]+>\s*")
_STOP = regex.compile(r"[.!?…。！？؟।»”’」』)\]\"'*_`]$")
_OPENER = regex.compile(r"(?:[(\[{«„“「『（,、，;:：–—-]|:\s*\"|\s\")$")
_CLAUSE = regex.compile(r"[.!?…。！？؟।,、，;:]+\s*|\n+")
_LIST = regex.compile(r"(?:^|\n)\s*\d{1,3}[.)]$")
_SPOKEN = regex.compile(r"\p{L}")
_NOT_WORDS = regex.compile(r"[^\p{L}\p{M}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}]+")
_MARKS = regex.compile(r"[\s\p{P}\p{S}\p{Z}\p{C}]")


def letters(text: str) -> str:
    """Its words in lower case with one blank between and around them."""
    return f" {_NOT_WORDS.sub(' ', text).strip().lower()} "


def bare(text: str) -> str:
    return _MARKS.sub("", text).casefold()


def has_listed(words: str, listed=REFUSALS) -> bool:
    return listed.search(words.replace("’", "'")) is not None


class Languages:
    """Naive Bayes over character 1- to 3-grams, every language equally likely before."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = list(counts)
        grams = sorted({g for c in counts.values() for g in c})
        self.row = {g: k for k, g in enumerate(grams)}
        self.log = np.empty((len(grams) + 1, len(counts)))  # the last row is of grams that no language has
        for k, c in enumerate(counts.values()):
            total = sum(c.values()) + len(grams) * 0.1
            self.log[:, k] = math.log(0.1 / total)
            self.log[[self.row[g] for g in c], k] = [math.log((n + 0.1) / total) for n in c.values()]

    @staticmethod
    def grams(words: str) -> list[str]:
        return [c for c in words if c != " "] + [words[i : i + n] for n in (2, 3) for i in range(len(words) - n + 1)]

    @classmethod
    def fit(cls, labelled: Iterable[tuple[str, str]]) -> dict[str, dict[str, int]]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in labelled:
            counts[lang].update(cls.grams(letters(text)))
        return {lang: dict(c) for lang, c in sorted(counts.items())}

    def scores(self, text: str) -> dict[str, float]:
        none = len(self.row)
        rows = [self.row.get(g, none) for g in self.grams(letters(text))]
        return dict(zip(self.langs, self.log[rows].sum(axis=0).tolist())) if rows else dict.fromkeys(self.langs, 0.0)

    def best(self, text: str) -> str | None:
        s = self.scores(text)
        return max(sorted(s), key=s.get) if s else None


class Refusals:
    """Naive Bayes over word 1- to 3-grams, and 2- to 4-grams of signs written without blanks, of refusals and others.

    Odds of a gram are drawn towards the prior by GRAM_WEIGHT replies, so what is seldom or never seen says little, and what
    is in fewer than LEAST refusals never speaks for one. Both hold for up to PER replies and grow with more, so odds
    don't grow with the number of replies. That a reply has a listed phrase is one more gram.
    """

    GRAM_WEIGHT, LEAST, PER, LISTED = 4.0, 3, 10_000, "=listed"

    def __init__(self, replies: tuple[int, int], grams: dict[str, tuple[int, int]]):
        (self.others, self.refusals), self.log, self.known = replies, {}, set()
        share, times = (self.refusals + 0.5) / (self.others + self.refusals + 1), self.times(sum(replies))
        w = self.GRAM_WEIGHT * times
        self.prior = math.log(share / (1 - share))
        for g, (o, r) in grams.items():
            self.log[g] = math.log((r + w * share) / (o + w * (1 - share))) - self.prior
            if r >= self.LEAST * times:
                self.known.add(g)
            else:
                self.log[g] = min(0.0, self.log[g])

    @classmethod
    def times(cls, replies: int) -> float:
        return max(1.0, replies / cls.PER)

    @classmethod
    def grams(cls, words: str, listed=REFUSALS) -> set[str]:
        w, out = letters(words).split(), set()
        if has_listed(words, listed):
            out.add(cls.LISTED)
        for n in (1, 2, 3):
            out.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        for m in _UNSPACED.finditer(words):
            for n in (2, 3, 4):
                out.update("~" + m[0][i : i + n] for i in range(len(m[0]) - n + 1))
        return out

    @classmethod
    def count(cls, labelled: Iterable[tuple[str, bool]], listed=REFUSALS) -> tuple[tuple[int, int], dict[str, tuple[int, int]]]:
        replies, grams = [0, 0], (Counter(), Counter())
        for words, declines in labelled:
            replies[declines] += 1
            grams[declines].update(cls.grams(words, listed))
        return (replies[0], replies[1]), {g: (grams[0][g], grams[1][g]) for g in grams[0] | grams[1]}

    @classmethod
    def fit(cls, replies: list[str], listed=REFUSALS) -> tuple[tuple[int, int], dict[str, tuple[int, int]]]:
        """Counts of replies and grams: labelled by the listed phrases, then by what is worded like those, twice."""
        seeds = [has_listed(t, listed) for t in replies]
        found = cls.count(zip(replies, seeds), listed)
        for _ in range(2):
            known = cls(*found)
            labels = [s or known.odds(t, True, listed) > RELABEL_ODDS for t, s in zip(replies, seeds)]
            found = cls.count(zip(replies, labels), listed)
        return found

    def odds(self, words: str, seen: bool = False, listed=REFUSALS) -> float:
        """The log odds that ``words`` decline; with ``seen`` by the grams of refusals alone, without the prior."""
        return self.odds_of(self.grams(words, listed), seen)

    def odds_of(self, gs: set[str], seen: bool = False) -> float:
        return sum(self.log[g] for g in gs & self.known) if seen else self.prior + sum(self.log.get(g, 0.0) for g in gs)

    def may_decline(self, gs: set[str]) -> bool:
        """Whether the grams that speak for a refusal could outweigh all others: only they need counts of their other grams."""
        return self.prior + sum(max(0.0, self.log[g]) for g in gs & self.known) > REFUSAL_ODDS - 1e-6


class Endings:
    """How likely the last characters of a clause are to end a complete text that has no end mark.

    ``ends``: suffixes of complete texts without a mark (instructions, and closing phrases that recur as a whole);
    ``goes_on``: the same n-grams where complete texts continue. Every suffix weighs in: what is counted of a longer
    one is smoothed by the odds of the next shorter.
    """

    LONGEST = 14

    def __init__(self, ends: dict[str, int], goes_on: dict[str, int]):
        self.ends, self.goes_on = ends, goes_on

    @classmethod
    def fit(cls, replies: list[str], instructions: list[str]) -> tuple[dict[str, int], dict[str, int]]:
        """From emoji-free replies and instructions.

        A tail is a closing phrase by the odds that clauses beginning with it end there, as those of a closing phrase
        do, or hardly ever, as where replies break off, or half of the time, as where they happen to break off alike. The
        test is the same in languages of any share; the prior is such that a reply written twice doesn't make its tail
        one, and among more replies a few more are needed (in the logarithm).
        """
        found = {kind: Counter() for kind in ("begun", "tail", "stopped")}
        for t in replies:
            for clause, kind in cls.clauses(t):
                found[kind][clause] += 1
        begun, tails = sorted(found["begun"].elements()), found["tail"]
        more = {t: bisect_left(begun, f"{t}\U0010ffff") - bisect_left(begun, t) for t in tails}
        ends = Counter()
        for t, n in [*cls.closing(tails, more, found["stopped"], len(replies)).items(), *((i.lower(), 1) for i in instructions)]:
            for g in cls.suffixes(t):
                ends[g] += n
        goes_on = Counter()
        for c, n in [*((f" {c} ", n) for c, n in found["stopped"].items()), *((f" {t.lower()}", 1) for t in instructions)]:
            for g in cls.inside(c, ends):
                goes_on[g] += n
        return dict(ends), dict(goes_on)

    @staticmethod
    def clauses(reply: str) -> Iterator[tuple[str, str]]:
        """The clauses of a reply in lower case: all as 'begun'; those of a complete one as 'stopped'; a whole reply that
        is a clause without a mark as 'tail'."""
        clauses = [c.strip() for c in _CLAUSE.split(reply) if c.strip()]
        for c in clauses:
            yield c.lower(), "begun"
        if clauses and not _STOP.search(reply) and not _OPENER.search(reply) and reply.lower().endswith(clauses[-1].lower()):
            if len(clauses) == 1:
                yield clauses[-1].lower(), "tail"
        else:
            for c in clauses:
                yield c.lower(), "stopped"

    @staticmethod
    def closing_odds(n: int, more: int = 0, replies: int = 0) -> float:
        """The odds of a tail that ends ``n`` replies and goes on in ``more`` clauses; the lower of those against both others."""
        more = max(0, more)
        broken = CLOSING_PRIOR + n * math.log(CLOSING_ENDS / BROKEN_ENDS) + more * math.log((1 - CLOSING_ENDS) / (1 - BROKEN_ENDS))
        chance = CHANCE_ODDS - math.log(max(1.0, replies / CHANCE_AMONG)) + n * math.log(CLOSING_ENDS / CHANCE_ENDS) + more * math.log((1 - CLOSING_ENDS) / (1 - CHANCE_ENDS))
        return min(broken, chance)

    @staticmethod
    def shorter(tail: str) -> list[str]:
        """The beginnings of a tail that end at a word's end."""
        return [tail[:k] for k in range(4, len(tail)) if not tail[k].isalpha()]

    @classmethod
    def closing(cls, tails: dict[str, int], begun: dict[str, int], stopped: Container[str], replies: int) -> dict[str, int]:
        """The closing phrases among the ``tails`` of replies; ``begun`` counts the clauses that begin with each."""
        return {t: n for t, n in tails.items() if cls.closing_odds(n, begun[t] - n, replies) > 0 and not any(c in stopped for c in cls.shorter(t))}

    @classmethod
    def suffixes(cls, text: str) -> list[str]:
        text = f" {text}"
        return [text[-k:] for k in range(1, min(len(text), cls.LONGEST) + 1)]

    @classmethod
    def inside(cls, text: str, ends: Container[str]) -> Iterator[str]:
        """The n-grams of ``text`` that it continues behind; of more than four signs only those that are ``ends``."""
        for k in range(1, cls.LONGEST + 1):
            for i in range(len(text) - k):
                g = text[i : i + k]
                if k <= 4 or g in ends:
                    yield g

    def odds(self, tail: str) -> float:
        """The log odds that a text ends behind ``tail``: each suffix's counts, smoothed by the share of the shorter one."""
        tail, share, known = f" {tail.lower()}", 0.5, False
        for k in range(1, min(len(tail), self.LONGEST) + 1):
            e, c = self.ends.get(tail[-k:], 0), self.goes_on.get(tail[-k:], 0)
            if e or c:
                share, known = (e + SMOOTHING * share) / (e + c + SMOOTHING), True
        share = min(max(share, 1e-12), 1 - 1e-12)
        return math.log(share / (1 - share)) if known else -math.inf

    def complete(self, tail: str) -> bool:
        return self.odds(tail) > 0


class Judge:
    """Gives the first defect of a sample that holds, or None."""

    def __init__(self, vocabulary: tuple[str, ...], languages: dict, ends: dict, goes_on: dict, refusals: tuple):
        self.vocabulary = vocabulary
        self.languages, self.endings, self.refusals = Languages(languages), Endings(ends, goes_on), Refusals(*refusals)
        self.forms = forms(vocabulary)
        #: beginnings of joined emoji, up to a joiner: what half an emoji ends in
        self.halves = tuple({v[: k + 1] for v in vocabulary for k, c in enumerate(v) if c == "\u200d"})
        self.asked: dict[tuple, tuple] = {}
        self.spoken: dict[str, dict] = {}
        self.declines: dict[str, bool] = {}

    def _prompt(self, instruction: str | None, prompt: str | None) -> tuple:
        key = (instruction, prompt)
        known = self.asked.get(key)
        if known is None:
            f = self.forms
            i = f.consistent(instruction or "")
            words = letters(i)
            lang = self.languages.best(words) if words.strip() else None
            if len(self.asked) > 100_000:
                self.asked.clear()
            known = self.asked[key] = (frozenset(f.emoji(f.consistent(prompt or ""))), bare(i), lang)
        return known

    def __call__(self, raw: str | None, known: bool, instruction: str | None, prompt: str | None) -> str | None:
        if raw is None or not raw.strip():
            return "empty"
        f = self.forms
        text = f.consistent(raw).strip()
        emoji = f.emoji(text) if not text.isascii() else []
        plain = text
        for e in set(emoji):
            plain = plain.replace(e, "\x00")
        plain = plain.strip()
        words = plain.replace("\x00", " ").strip()
        if not emoji:
            b = bare(words)
            if not b or b in STAND_INS:
                return "empty"
        spoken = bool(words) and _SPOKEN.search(words) is not None
        if spoken and self._declines(words):
            return "refusal"
        if known:
            asked, wanted, lang = self._prompt(instruction, prompt)
            if emoji and frozenset(emoji) == asked:
                return "copy"
            if spoken and wanted and bare(_LABEL.sub("", _ARROW.sub("", words))) == wanted:
                return "copy"
        if raw[-1] == "\u200d" and raw.endswith(self.halves) or self.breaks_off(text, plain, emoji):
            return "truncated"
        if known and spoken and lang:
            said = letters(_LABEL.sub("", _ARROW.sub("", words)))
            if len(said) - said.count(" ") >= MIN_LETTERS or not said.isascii():
                scores = self.spoken.get(said)
                if scores is None:
                    if len(self.spoken) > 100_000:
                        self.spoken.clear()
                    scores = self.spoken[said] = self.languages.scores(said) if said.strip() else {}
                if scores and max(scores.values()) - scores.get(lang, -math.inf) >= MIN_ODDS:
                    return "other_language"
        return None

    def _declines(self, words: str) -> bool:
        known = self.declines.get(words)
        if known is None:
            if len(self.declines) > 100_000:
                self.declines.clear()
            known = self.declines[words] = has_listed(words) or self.refusals.odds(_LABEL.sub("", _ARROW.sub("", words))) > REFUSAL_ODDS
        return known

    def breaks_off(self, text: str, plain: str, emoji: list[str]) -> bool:
        """Whether the reply ends before its end: half an emoji, an open list item, quotation or bracket, or a tail that ends nothing."""
        if not plain or plain[-1] == "\x00":
            if emoji and len(emoji[-1]) == 1 and "\U0001f1e6" <= emoji[-1] <= "\U0001f1ff":
                return True
            return plain.count('"') % 2 == 1 and plain.startswith('"') or plain.endswith("(\x00")
        if _LIST.search(plain):
            return True
        if _OPENER.search(plain):
            return True
        if plain[-1] == '"':
            return plain.count('"') % 2 == 1
        if plain[-1] in "'’" and plain[-2:-1].isalpha() and plain.count(plain[-1]) % 2 == 1 and plain[:1] not in "'‘":
            return True
        if _STOP.search(plain):
            return False
        if not any(c.isalpha() for c in plain[-20:]):
            return False
        tail = _CLAUSE.split(plain.rsplit("\x00", 1)[-1])[-1].strip()
        return not self.endings.complete(tail)


_judges: dict[int, Judge] = {}


def _judge(model: tuple) -> Judge:
    key = id(model)
    if key not in _judges:
        _judges.clear()
        _judges[key] = (model, Judge(*model))
    return _judges[key][1]


def looked_up(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``rows`` with the row of their benchmark_id in ``keyed`` (unique on it), if any.

    ``keyed`` is broadcast only when counted small, else looked up so that a hot benchmark_id is no hot task.
    """
    if is_small(keyed, BROADCAST_ROWS // 10):
        return rows.join(F.broadcast(keyed), "benchmark_id", "left")
    counted = rows.groupBy("benchmark_id").agg(F.count("*").alias("_n"))
    return lookup_skewed(rows, durable(keyed.join(counted, "benchmark_id")), ["benchmark_id"], "_n", "left").drop("_n")


def _lang() -> Column:
    return F.nullif(F.lower(strip(F.col("lang"))), F.lit(""))


def instruction_texts(benchmark: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """(text, lang, n): the distinct instructions in consistent form."""

    def make():
        f = forms(vocabulary)
        return lambda instruction, lang: [([(f.consistent(instruction), lang)], 1)]

    rows = benchmark.filter("instruction IS NOT NULL").select("instruction", _lang().alias("lang"))
    return durable(tally(rows, make, ["text", "lang"]))


def reply_texts(samples: DataFrame, benchmark: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """(text, lang, fits, n, grams, bare): the distinct emoji-free replies with letters and the languages they were asked in.

    ``fits``: two letters stand together, so the models are fitted on it; ``grams``: those of ``Refusals``, made once,
    one to a line.
    """
    named = benchmark.filter("benchmark_id IS NOT NULL AND instruction IS NOT NULL")
    langs = named.groupBy("benchmark_id").agg(F.min(_lang()).alias("lang"))
    letter = F.col("raw_prediction").rlike(r"\p{L}")
    rows = looked_up(samples.filter(letter).select("benchmark_id", "raw_prediction"), langs)
    rows = rows.select("raw_prediction", "lang", F.col("raw_prediction").rlike(r"\p{L}{2}").cast("string").alias("fits"))

    def make():
        f = forms(vocabulary)

        def one(raw, lang, fits):
            t = f.consistent(raw)
            for e in () if t.isascii() else set(f.emoji(t)):
                t = t.replace(e, "\n")
            yield [(_LABEL.sub("", _ARROW.sub("", t)).strip(), lang, fits)], 1

        return one

    def told(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            more = {"grams": pa.array(["\n".join(Refusals.grams(t)) for t in texts], pa.string()), "bare": pa.array([bare(t) for t in texts], pa.string())}
            yield pa.record_batch([*b.columns, *more.values()], names=[*b.schema.names, *more])

    texts = durable(tally(rows, make, ["text", "lang", "fits"]).filter("text <> ''"))
    parts = max(samples.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // FIT_PART))
    return durable(texts.repartition(parts).withColumn("fits", F.col("fits") == "true").mapInArrow(told, "text string, lang string, fits boolean, n bigint, grams string, bare string"))


def fit_languages(texts: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of grams per language of (text, lang, n, sure).

    Replies in another language than asked blur the labels: those not sure are relabelled once by the first fit.
    """

    counts: dict[str, Counter] = defaultdict(Counter)

    def add(rows: DataFrame, make: Callable[[], Callable]) -> None:
        for r in tally(rows, make, ["lang", "gram"]).collect():
            counts[r.lang][r.gram] += r.n

    def found() -> dict[str, dict[str, int]]:
        return {lang: {g: n for g, n in sorted(c.items()) if n} for lang, c in sorted(counts.items()) if any(c.values())}

    add(texts.select("text", "lang", "n"), lambda: lambda text, lang, n: [(zip(repeat(lang), Languages.grams(letters(text))), n)])
    known = found()

    def make():
        first = Languages(known)

        def one(text, lang, n):
            best = first.best(text)
            if best != lang:
                gs = Languages.grams(letters(text))
                yield zip(repeat(lang), gs), -n
                yield zip(repeat(best), gs), n

        return one

    add(texts.filter("NOT sure").select("text", "lang", "n"), make)
    return found()


def fit_refusals(texts: DataFrame) -> tuple[tuple[int, int], dict[str, tuple[int, int]]]:
    """Counts of replies and grams over (grams, n, fits), labelled as by ``Refusals.fit``.

    Of the grams there are those that speak for a refusal, and all of the texts that these could make one; with no other
    gram's count would one of ``texts`` be judged differently. So only their counts leave the tasks.
    """
    fits = texts.filter("fits").select("grams", "n")

    def labels(model: tuple | None) -> Callable[[set[str]], bool]:
        known = Refusals(*model) if model else None
        return lambda gs: Refusals.LISTED in gs or known is not None and known.odds_of(gs, True) > RELABEL_ODDS

    def refused(model: tuple | None) -> DataFrame:
        def make():
            label = labels(model)

            def one(grams, n):
                gs = grams.split("\n")
                if label(set(gs)):
                    yield [("refusals", "")], n
                    yield zip(repeat("gram"), gs), n
                else:
                    yield [("others", "")], n

            return one

        return tally(fits, make, ["kind", "gram"])

    def replies_with(grams: Container[str], refusals_of: tuple | None = None, only: bool = False) -> Counter:
        """How many replies, or with ``only`` those labelled refusals by a model, have each of the grams."""

        def make():
            label = labels(refusals_of)

            def one(gs, n):
                gs = set(gs.split("\n"))
                told = gs & grams
                return [(zip(told), n)] if told and (not only or label(gs)) else []

            return one

        return Counter({r.gram: r.n for r in tally(fits, make, ["gram"]).collect()})

    least = Refusals.LEAST * Refusals.times(fits.agg(F.sum("n")).first()[0] or 0)
    every: Counter = Counter()
    before = model = None
    for _ in range(3):
        before = model
        rows = refused(before).filter((F.col("kind") != "gram") | (F.col("n") >= least)).collect()
        replies = {r.kind: r.n for r in rows if r.kind != "gram"}
        declines = {r.gram: r.n for r in rows if r.kind == "gram"}
        new = declines.keys() - every.keys()
        if new:
            every |= replies_with(new)
        model = ((replies.get("others", 0), replies.get("refusals", 0)), {g: (every[g] - r, r) for g, r in declines.items()})

    def make():
        known = Refusals(*model)

        def one(grams):
            gs = set(grams.split("\n"))
            return [(zip(gs - known.known), 1)] if known.may_decline(gs) else []

        return one

    rest = {r.gram for r in tally(texts.select("grams"), make, ["gram"]).collect()}
    if rest:
        n, r = replies_with(rest), replies_with(rest, before, True)
        return model[0], model[1] | {g: (n[g] - r[g], r[g]) for g in rest}
    return model


def fit_endings(texts: DataFrame, instructions: DataFrame, refusals: tuple) -> tuple[dict[str, int], dict[str, int]]:
    """(ends, goes_on) as by ``Endings.fit``, of (text, n, grams) without refusals, and of instructions (text, n)."""

    def told():
        known = Refusals(*refusals)
        return lambda text, n, grams: [] if known.odds_of(set(grams.split("\n"))) > REFUSAL_ODDS else [(Endings.clauses(text), n), ([("", "reply")], n)]

    clauses = durable(tally(texts.select("text", "n", "grams"), told, ["clause", "kind"]))
    replies = clauses.filter("kind = 'reply'").agg(F.sum("n")).first()[0] or 0
    tails = {r.clause: r.n for r in clauses.filter("kind = 'tail'").filter(F.col("n") >= _least_tail(replies)).collect()}
    shorter = {c for t in tails for c in Endings.shorter(t)}

    def seen():
        def one(clause, kind, n):
            if kind == "begun":
                return [([("begun", clause[:k]) for k in range(1, len(clause) + 1) if clause[:k] in tails], n)]
            return [([("stopped", clause)], n)] if clause in shorter else []

        return one

    found = {"begun": Counter(), "stopped": Counter()}
    for r in tally(clauses.filter("kind IN ('begun', 'stopped')").select("clause", "kind", "n"), seen, ["kind", "text"]).collect():
        found[r.kind][r.text] = r.n
    ends: Counter = Counter()
    for t, n in Endings.closing(tails, found["begun"], found["stopped"], replies).items():
        for g in Endings.suffixes(t):
            ends[g] += n
    for r in tally(instructions.select("text", "n"), lambda: lambda text, n: [(zip(Endings.suffixes(text.lower())), n)], ["gram"]).collect():
        ends[r.gram] += r.n
    ends = dict(ends)
    whole = clauses.filter("kind = 'stopped'").select(F.format_string(" %s ", "clause").alias("text"), "n")
    asked = tally(instructions.select("text", "n"), lambda: lambda text, n: [([(f" {text.lower()}",)], n)], ["text"])
    inside = lambda: lambda text, n: [(zip(Endings.inside(text, ends)), n)]
    return ends, {r.gram: r.n for r in tally(whole.unionByName(asked), inside, ["gram"]).collect()}


def _least_tail(replies: int) -> int:
    """The fewest replies that end in a closing phrase: with fewer its odds are against it however seldom it goes on."""
    return next(n for n in range(1, 1000) if Endings.closing_odds(n, 0, replies) > 0)


def fit(samples: DataFrame, benchmark: DataFrame, vocabulary: tuple[str, ...]) -> tuple:
    """(language counts, ends, goes_on, refusal counts) fitted on all replies with letters and on all instructions.

    An instruction is labelled by its lang, a reply by the lang of its benchmark: most replies answer in the language
    asked. Of refusal grams there are the counts that judging ``samples`` takes (``fit_refusals``).
    """
    instructions = instruction_texts(benchmark, vocabulary)
    texts = reply_texts(samples, benchmark, vocabulary)
    fits = texts.filter("fits")
    asked = instructions.withColumn("sure", F.lit(True))
    languages = fit_languages(asked.unionByName(fits.select("text", "lang", "n", F.lit(False).alias("sure"))).filter("lang IS NOT NULL"))
    refusals = fit_refusals(texts)
    # a copied instruction with a stop says nothing on endings without one
    copies = tally(instructions.select("text"), lambda: lambda text: [([(bare(text),)], 1)], ["bare"]).select("bare")
    ends, goes_on = fit_endings(fits.join(copies, "bare", "left_anti"), instructions, refusals)
    return languages, ends, goes_on, refusals


def defects(samples: DataFrame, benchmark: DataFrame, vocabulary: tuple[str, ...], model: tuple | None = None) -> DataFrame:
    """(sample_id, defect), one row per defective sample: empty, refusal, copy, truncated or other_language, the first that holds.

    Samples without a benchmark row are never copy or other_language; a benchmark_id that occurs twice counts once.
    """
    if model is None:
        model = fit(samples, benchmark, vocabulary)
    asked = benchmark.filter("benchmark_id IS NOT NULL").dropDuplicates(["benchmark_id"]).select("benchmark_id", "instruction", "prompt_emoji", F.lit(True).alias("known"))
    whole = (vocabulary, *model)
    shared = samples.sparkSession.sparkContext.broadcast(whole)

    def judge(batches):
        one = _judge(shared.value)
        for batch in batches:
            ids, out = [], []
            cols = [batch.column(c).to_pylist() for c in ("sample_id", "raw_prediction", "known", "instruction", "prompt_emoji")]
            for sample, raw, known, instruction, prompt in zip(*cols):
                d = one(raw, bool(known), instruction, prompt)
                if d:
                    ids.append(sample)
                    out.append(d)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["sample_id", "defect"])

    rows = samples.select("sample_id", "benchmark_id", "raw_prediction")
    joined = looked_up(rows, asked)
    return joined.select("sample_id", "raw_prediction", "known", "instruction", "prompt_emoji").mapInArrow(judge, "sample_id bigint, defect string")
