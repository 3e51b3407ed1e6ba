"""Problem 4: broken prompt and response pairs, by a conditional random field over clauses.

A response is divided into clauses, each clause is described by features against its prompt
(language, share of words and word runs taken from the prompt, refusal wording, how it
begins and ends) and a linear-chain conditional random field tags it as answer, refusal,
echo, foreign or unfinished. The tags' shares of the response's words decide the defect.

Word statistics are counted over all prompts. The lexicon holds the ``MAX_WORDS`` most
frequent words and as many of those that tell a language or end no phrase. What it lacks
comes by joins: the telling words of a pair with that pair, and for a last word that may be
broken off the counts of all words. The field is
trained on clauses of known tags made from at most ``max_examples`` sound-looking pairs of
the data: cut at random places, replaced by their prompt, by text of another language or
by the refusals below. Pairs are scored row by row; nothing is dropped.

Defined results: a null response is empty; a response without letters or digits, or with a
place-holder only, is empty; a null prompt can't be copied and has no language; very long
responses are tagged whole; repeated rows are judged each; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from bisect import bisect_left
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import cut, hash_sample, sized_join

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
MAX_WORDS = 60_000

#: Frequent words by language (fixed values).
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be at from or an which not but have has we our each when while they their than because even if without under after under how what who does do where why between",
    "de": "der die das und ist von zu mit den im für auf nicht ein eine einen dem des sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie nur oder aber über ohne obwohl unser unsere mehrere wird wer was warum wo zum zur",
    "fr": "le la les de des et en est un une du dans que qui pour pas par sur au avec ne se sont plus ce cette ces nous notre aux mais ou leur être fait sans après rarement plusieurs malgré souvent toujours aussi quel quelle pourquoi où",
    "es": "el la los las de una un unos del y que en es por con no para se su al lo como más pero sus este esta estos nuestro nuestra sin sobre también varias según después a menudo siempre casi todos qué quién cuál dónde demasiados",
    "it": "il la lo gli di e è un che per con non una del della sono nel alla più anche questo come ma dei delle si",
    "pt": "o os as e é a de um uma do da dos das em no na para com não que por mais como foi ao são também esta nosso",
    "nl": "de het een en van is dat op te met voor niet zijn aan er ook als bij maar uit naar wordt door",
}
_WORD_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _list in LANGUAGE_WORDS.items():
    for _w in _list.split():
        _WORD_LANGUAGES[_w] = tuple(dict.fromkeys((*_WORD_LANGUAGES.get(_w, ()), _lang)))

#: Words after which a phrase can't end.
OPEN_ENDS = set(
    "the a an of and or but to in on at by for with from as is are was were be been than that which who whose when while whereas because since so if even under after before between into onto across over without despite each our its their this these those not very more most can may does do has have had only such where we it they".split()
) | set("der die das den dem des ein eine einen einem und oder aber von zu mit im für auf als dass bei um ist sind wird zum zur am obwohl ohne nach le la les un une des du de et ou que qui dans pour par sur au aux avec sans est sont ce cette el los las una del y o en por con para su al lo como es sin".split())

PLACE_HOLDERS = set(
    "n/a na n.a none null nil nan undefined empty blank tbd todo ... unknown output response placeholder".split()
) - {"unknown"} | {"no answer given", "no answer", "not available", "not applicable", "no output", "no response", "no reply", "no text", "answer missing", "nothing", "no summary", "no content", "left blank", "answer here", "insert answer here", "your answer here", "to be filled", "keine angabe", "sin respuesta", "pas de réponse", "no data", "missing", "void", "leer", "vide", "vacío", "无", "暂无"}

MOST_PLACE_WORDS = max(len(p.split()) for p in PLACE_HOLDERS) + 1
_ALNUM = re.compile(r"[^\W_]")


class _Unseen(dict):
    """Format and control characters to nothing, all others to themselves; filled as they come."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c) in ("Cf", "Cc") and not c.isspace() else code
        return self[code]


_UNSEEN = _Unseen()

#: Refusals to train on; {a} and {b} are varied.
_REFUSALS = """I am sorry, I cannot {b}.|I'm sorry, but I can't {b}.|Sorry, I won't {b}.|Unfortunately, I am unable to {b}.|As an assistant, I cannot {b}.|As an AI language model, I am not able to {b}.|I must decline to {b}.|I would rather not {b}.|Apologies, I can't {b}.|I regret that I cannot {b}.|It is not possible for me to {b}.
I refuse to {b}.|I do not feel comfortable with this request.|I don't have access to the paper, so I can't {b}.|My guidelines do not allow me to {b}.|My instructions do not permit an answer.|This request is against the rules, so no answer is given.|Request refused.|Request denied.|This is outside what this assistant is allowed to do.|No answer can be provided due to the safety policy.
That goes against my guidelines.|I have to decline this request.|I prefer not to {b}.|I'm not allowed to {b} because of my guidelines.|I can't comment on that. Is there anything else you need?|Please ask an expert instead, I cannot {b}.|This content violates the usage policy.|The assistant may not answer this.|As a language model I have no opinion on this.
Es tut mir leid, ich kann das nicht beantworten.|Leider kann ich dabei nicht helfen.|Ich darf diese Frage nicht beantworten.|Je suis désolé, je ne peux pas répondre.|Désolé, je ne peux pas aider avec cette demande.|Lo siento, no puedo responder a esta pregunta.|No puedo ayudar con esta solicitud.|对不起，我无法回答这个问题。|抱歉，我不能提供帮助。"""
_TASKS = ["answer this question", "help with this request", "assist with that", "provide a summary of this text", "discuss this topic", "fulfil this task", "give phrases for this text", "comment on this", "produce an answer", "complete this task"]
#: Sound sentences that use such words of others.
_SOUND = ["The authors cannot run the parser on the corpus.", 'The annotators say: "I cannot tell" for most items.', "The model refuses to answer when the prompt is missing.", "The reader declines unsafe prompts of the corpus.", "They apologise for the missing table in a footnote.", "The system is not able to read long tables.", "The corpus is not available to them.", 'They quote "I am sorry" from the dialogues.', "no", "yes", "unanswerable", "It cannot handle negation."]

_QUOTED = re.compile("[\"“”„«»][^\"“”„«»\n]{0,400}[\"“”„«»]|(?<!\\w)['‘][^'’\n]{2,200}['’](?!\\w)")
_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+(?:[-'’][^\W_㐀-鿿぀-ヿ]+)*")
#: All begin with one set of signs, by which they are searched.
_CLAUSE = re.compile(r"[.!?…。！？;:,\n](?:(?<=[.!?…])[.!?…]*(?=[\s\"'”)\]]|$)[\"'”)\]]*\s*|(?<=[。！？])|(?<=[;:,\n])(?=\s|$)\s*|(?<=\n))")
_MARK = re.compile(r"^(?:[-*•]|\d+[.)])\s+")
_FIRST = re.compile(r"\b(?:i|i'm|i’m|i'd|me|my|assistant|ai|ich|mir|je|j'|yo|lo siento|désolé|désolée)\b|我|抱歉|对不起")
_CANNOT = re.compile(r"\b(?:cannot|can't|can’t|can not|could not|unable|won't|won’t|will not|not able|not possible|decline[sd]?|declining|refuse[sd]?|rather not|prefer not|not comfortable|no access|not have access|don't have access|not allow(?:ed)?|not permit(?:ted)?|may not|darf|kann|nicht|ne peux|puedo|puede)\b|无法|不能")
_SORRY = re.compile(r"\b(?:sorry|apologies|apologi[sz]e|unfortunately|regret|leider|tut mir leid|désolée?|lo siento)\b|抱歉|对不起")
_RULES = re.compile(r"\b(?:guidelines|instructions|policy|policies|usage rules|rules|safety|settings|assistant|language model|request|violates?|allowed|anything else you need|ask an expert)\b")
_GIVEN = re.compile(r"\b(?:answer|reply|response|help|assist|provided?|given|task|comment|topic|denied|refused|declined|against|outside|expert)\b")
_ANY = re.compile("|".join(p.pattern for p in (_CANNOT, _SORRY, _RULES)))
_ANSWER_IS = re.compile(r"(?:the answer is|answer|it is|that is|this is)\b")
_ASKED = re.compile(r"(?:you asked|the question|question|on the question|asked)\b")
_SCRIPTS = (("ru", re.compile("[Ѐ-ӿ]")), ("zh", re.compile("[一-鿿]")), ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("hi", re.compile("[ऀ-ॿ]")))
N_FEATURES = 40

#: A sign for each set of languages that a word may have.
_KINDS = {kind: chr(33 + i) for i, kind in enumerate(dict.fromkeys([*_WORD_LANGUAGES.values(), *((x,) for x in LANGUAGE_WORDS), *((x,) for x, _ in _SCRIPTS)]))}
_OF_KIND = {sign: kind for kind, sign in _KINDS.items()}

#: The beginnings of all that _ANY finds in ASCII text, as runs of letters.
_ANY_BEGINS = set(
    "cannot can could unable won will not decline declines declined declining refuse refuses refused rather prefer no have don may darf kann nicht ne puedo puede sorry apologies apologise apologize unfortunately regret leider tut d lo guidelines instructions policy policies usage rules safety settings assistant language request violate violates allowed anything ask".split()
)
_GAPS = bytes(i if chr(i).isalnum() or chr(i) in "-'" else 32 for i in range(128)).ljust(256)
_NO_LETTERS = bytes(i if chr(i).isalpha() else 32 for i in range(128)).ljust(256)
_LOOSE = re.compile(r"[-'](?:(?<![A-Za-z0-9].)|(?![A-Za-z0-9]))")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*")


def words_in(text: str) -> list[str]:
    """What _WORD finds, sooner in ASCII text."""
    if not text.isascii():
        return _WORD.findall(text)
    spaced = text.encode().translate(_GAPS).decode()
    if ("-" in spaced or "'" in spaced) and _LOOSE.search(spaced):
        return _ASCII_WORD.findall(spaced)
    return spaced.split()


def refuses_nothing(plain: str) -> bool:
    """Whether _ANY finds nothing in a text of small letters."""
    if plain.isascii() and _ANY_BEGINS.isdisjoint(plain.encode().translate(_NO_LETTERS).decode().split()):
        return True
    return not _ANY.search(plain)


def is_empty(text: str | None) -> bool:
    """Nothing said: null, no letters or digits, or a place-holder only."""
    if text is None or not _ALNUM.search(text):
        return True
    words = (text if text.isascii() and text.isprintable() else text.translate(_UNSEEN)).split(None, MOST_PLACE_WORDS)
    if len(words) > MOST_PLACE_WORDS:
        return False
    low = " ".join(words).lower()
    return low.strip(" .()[]{}<>\"'-_*:") in PLACE_HOLDERS or low in PLACE_HOLDERS


class Lexicon:
    """Languages of words, known words and words that end no phrase, from counts over all prompts."""

    def __init__(self, counts: dict[str, tuple[int, str, int, int]] | None = None, whole: bool = True, telling: dict[str, tuple[int, str, int, int]] | None = None, told: bool = True):
        """counts: word to (all, most frequent language, lower case ones in it, ones at an end); ``whole``: of all words.

        ``telling``: the same of rarer words that tell a language or end no phrase; ``told``: there are no more.
        """
        self.whole, self.told = whole, told
        self.language, self.open_ends = self.roles({**(telling or {}), **(counts or {})})
        self.language |= {w: _KINDS[kind] for w, kind in _WORD_LANGUAGES.items()}
        self.open_ends |= dict.fromkeys(OPEN_ENDS)
        self.count: dict[str, int] = {w: 10**6 for w in _WORD_LANGUAGES}
        for w, (n, *_) in (counts or {}).items():
            self.count[w] = max(n, self.count.get(w, 0))
        self.sorted = sorted(w for w, n in self.count.items() if n >= 5)
        self.begun: dict[tuple[str, int], bool] = {}

    @staticmethod
    def roles(counts: dict[str, tuple[int, str, int, int]]) -> tuple[dict[str, str], dict[str, None]]:
        """Languages of words, by the signs of _KINDS, and words that end no phrase."""
        language = {w: _KINDS[name,] for w, (n, name, of_it, _) in counts.items() if name and of_it >= 20 and of_it >= 0.9 * n}
        return language, {w: None for w, (n, _, of_it, ends) in counts.items() if n >= 200 and ends < 0.002 * n and of_it >= 0.5 * n and w.replace("-", "").isalpha()}

    def joined(self, counts: dict[str, tuple[int, str, int, int]]) -> Lexicon:
        """This lexicon with some words that it lacks."""
        counts = {w: c for w, c in counts.items() if w not in _WORD_LANGUAGES}
        made = copy.copy(self)
        language, open_ends = self.roles(counts)
        made.language, made.open_ends = ChainMap(language, self.language), ChainMap(open_ends, self.open_ends)
        made.count = ChainMap({w: c[0] for w, c in counts.items()}, self.count)
        return made

    def fragment(self, word: str, near: set[str], before: list[str], name: bool, asked: list | None = None) -> bool:
        """Whether a word is the beginning of others and far rarer than they.

        Names are compared with those of the prompt and of the response only: one complete
        name may well begin another. Where the lexicon lacks words and the rest could decide
        otherwise, the question (word, begins one near, name) is put into ``asked``.
        """
        if word in near or not word or word[0].isdigit() or word in _WORD_LANGUAGES:
            return False
        own = self.count.get(word, 0)
        ask = not self.whole and asked is not None
        if own < 5 or ask and not name:
            begins = any(w.startswith(word) for w in near) or any(w.startswith(word) and w != word for w in before)
            if ask and (begins and not own or not name):
                asked.append((word, begins, name))
            if own < 5 and begins:
                return True
        return not name and self.rarer(word, own)

    def rarer(self, word: str, own: int) -> bool:
        """Whether a word of ``own`` occurrences is far rarer than those it begins; frequent answers are kept."""
        made = self.begun.get((word, own))
        if made is None:
            mass, k = 0, bisect_left(self.sorted, word)
            while k < len(self.sorted) and self.sorted[k].startswith(word) and mass <= 20 * own + 100:
                mass += self.count[self.sorted[k]] * (self.sorted[k] != word)
                k += 1
            made = mass > 20 * own
            if len(self.begun) < 20_000:
                self.begun[word, own] = made
        return made

    def of(self, text: str, words: list[str]) -> str:
        """The language of a text, '' if it can't be told."""
        if not text.isascii():
            letters = sum(c.isalpha() for c in text)
            for name, pattern in _SCRIPTS:
                n = len(pattern.findall(text))
                if n and (n >= 0.3 * letters or (name == "zh" and n >= 0.15 * letters)):
                    return name
        seen: dict[str, float] = {}
        known = 0
        kinds = "".join(map(self.language.get, words, repeat("")))
        while kinds:
            rest = kinds.replace(kinds[0], "")
            languages, n = _OF_KIND[kinds[0]], len(kinds) - len(rest)
            known += n
            for name in languages:  # a word of several languages counts for each, but less
                seen[name] = seen.get(name, 0.0) + n * (1.0 if len(languages) == 1 else 0.6)
            kinds = rest
        if not seen:
            return ""
        best = max(seen, key=seen.get)
        return best if [*seen.values()].count(seen[best]) == 1 and seen[best] >= 1.6 and seen[best] >= 0.55 * known else ""


class Prompt:
    """What features need of a prompt; most of it is made when it is asked for."""

    def __init__(self, text: str | None, lexicon: Lexicon):
        self.low, self.lexicon = (text or "").lower(), lexicon
        self.words = words_in(self.low)
        self.runs = None

    @cached_property
    def set(self) -> set[str]:
        return set(self.words)

    @cached_property
    def language(self) -> str:
        return self.lexicon.of(self.low, self.words) if self.low else ""

    def has_runs(self, words: list[str]) -> float:
        if self.runs is None:
            self.runs = set(zip(self.words, self.words[1:], self.words[2:]))
        n = len(words) - 2
        return sum(r in self.runs for r in zip(words, words[1:], words[2:])) / n if n > 0 else 0.0


def unmarked(text: str) -> str:
    """A text without the mark of a list entry."""
    m = _MARK.match(text)
    return text[m.end() :] if m else text


def clauses(text: str) -> list[tuple[str, str]]:
    """Clauses and what ends them."""
    out, at = [], 0
    for m in _CLAUSE.finditer(text):
        end = m.group().strip()
        if _ALNUM.search(body := unmarked(text[at : m.start()].strip())):
            out.append((body, end or "\n"))
        elif out and end:
            out[-1] = (out[-1][0], end)
        at = m.end()
    if (body := text[at:].strip()) and _ALNUM.search(body):
        out.append((unmarked(body), ""))
    elif body and out:
        out[-1] = (out[-1][0], out[-1][1] + body)
    return out


def unquoted(text: str) -> str:
    return _QUOTED.sub(" _ ", text.replace("​", "")) if '"' in text or "“" in text or "'" in text or "«" in text or "„" in text else text


def describe(text: str, prompt: Prompt, lexicon: Lexicon, long_prompt: bool, unseen: bool | None = False, asked: list | None = None) -> tuple[list[list[int]], list[int]]:
    """Features of each clause, and the words in each; ``unseen``: the last word is in no prompt, None: it is whole."""
    bare = unquoted(text)
    parts = clauses(bare)
    if not parts:
        return [], []
    whole_words = [words_in(p.lower()) for p, _ in parts]
    everything = [w for ws in whole_words for w in ws]
    language = lexicon.of(bare, everything)
    same = bool(language) and language == prompt.language
    differs = bool(language and not same and prompt.language)
    first_line = whole_words[0]
    plain = bare.lower()
    nothing_refused = refuses_nothing(plain)
    first_person = not nothing_refused and bool(_FIRST.search(plain))
    ended = parts[-1][1]
    out, sizes = [], []
    last = len(parts) - 1
    for i, ((body, end), ws) in enumerate(zip(parts, whole_words)):
        f = [0]
        low = body.lower()
        n = len(ws)
        f.append(1 if n <= 2 else 2 if n <= 5 else 3 if n <= 10 else 4)
        if i == 0:
            f.append(5)
        if i == last:
            f.append(6)
            if not end:
                f.append(7)
                if len(everything) >= 3 and ws and ws[-1] in (OPEN_ENDS if long_prompt else lexicon.open_ends) and (body[-1].isalpha() or body[-1] == "-"):
                    f.append(9)
                if len(everything) >= 4 and body[-1].isalnum() and (unseen or unseen is not None and lexicon.fragment(ws[-1], prompt.set, everything, not words_in(body)[-1].islower(), asked)):
                    f.append(10)
            elif end[-1] in ",;:":
                f.append(11)
            if end.endswith(("…", "...")) or body.endswith(("...", "…")):
                f.append(12)
            if bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]"):
                f.append(13)
            if i and n >= 3 and ws[: len(first_line)] == first_line and "\n" in bare:
                f.append(14)
            if ended and ended[0] in ".!?。！？":
                f.append(15)
        if differs:
            f.append(16)
            if lexicon.of(body, ws) not in ("", prompt.language):
                f.append(17)
        elif same:
            f.append(18)
        cannot = sorry = rules = None
        if not nothing_refused:
            cannot, sorry, rules = _CANNOT.search(low), _SORRY.search(low), _RULES.search(low)
        if sorry:
            f.append(19)
        if cannot:
            f.append(20)
            if first_person:
                f.append(21)
        if rules:
            f.append(22)
            if _GIVEN.search(low):
                f.append(23)
        if first_person:
            f.append(24)
        if "_" in body:
            f.append(25)
        if nothing_refused:
            f.append(38)
        answers = bool(_ANSWER_IS.match(low))
        if ws and prompt.words:
            if long_prompt:
                if n >= 5 and n - 0.5 * sum("㐀" <= w[0] <= "鿿" for w in ws) >= 5:  # two signs make a word
                    share = prompt.has_runs(ws)
                    f.append(26 if share >= 0.8 else 27 if share >= 0.5 else 28)
                elif n >= 2 and len(everything) >= 12 and "\n" not in bare and prompt.set.issuperset(ws):
                    f.append(29)
            else:
                share = 0.0 if answers else sum(map(prompt.set.__contains__, ws)) / n
                if n >= 3:
                    f.append(30 if share >= 0.85 else 31 if share >= 0.5 else 32)
                elif share == 1:
                    f.append(33)
                if n >= 3 and share >= 0.7 and n >= 0.6 * len(prompt.words):
                    f.append(34)
        if _ASKED.match(low):
            f.append(35)
        if answers:
            f.append(36)
        if body[:1].islower():
            f.append(37)
        out.append(f)
        sizes.append(max(n, 1))
    return out, sizes


class Field:
    """Linear-chain conditional random field over sparse binary features."""

    def __init__(self):
        self.w = np.zeros((N_FEATURES, len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))
        self.kept: dict[tuple, list[int]] = {}

    @staticmethod
    def pad(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Dense features (rows, clauses, features) and lengths."""
        length = np.array([len(r) for r in rows])
        x = np.zeros((len(rows), max(length.max(), 1), N_FEATURES))
        for i, r in enumerate(rows):
            for j, f in enumerate(r):
                x[i, j, f] = 1
        return x, length

    def fit(self, rows: list[list[list[int]]], tags: list[list[int]], steps: int = 200, penalty: float = 0.0005) -> Field:
        same = Counter((tuple(map(tuple, r)), tuple(t)) for r, t in zip(rows, tags))  # equal examples are one with a weight
        x, length = self.pad([r for r, _ in same])
        n, m, _ = x.shape
        y = np.zeros((n, m, len(TAGS)))
        for i, (_, t) in enumerate(same):
            y[i, np.arange(len(t)), t] = 1
        weight = np.array([*same.values()], float) / sum(same.values())
        mask = np.arange(m) < length[:, None]
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        gold_pairs = np.einsum("n,nta,ntb->ab", weight, y[:, :-1], y[:, 1:])
        for s in range(1, steps + 1):
            e = x @ self.w
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0]
            for k in range(1, m):
                z = forward[:, k - 1, :, None] + self.t
                top = z.max(1)
                step = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[:, k]
                forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
            for k in range(m - 2, -1, -1):
                z = self.t + (e[:, k + 1] + backward[:, k + 1])[:, None, :]
                top = z.max(2)
                step = top + np.log(np.exp(z - top[..., None]).sum(2))
                backward[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
            top = forward[:, -1].max(1)
            total = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(1))
            p = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0)) * mask[..., None]
            pairs = np.zeros_like(self.t)
            for k in range(m - 1):
                live = mask[:, k + 1]
                z = forward[live, k, :, None] + self.t + (e[live, k + 1] + backward[live, k + 1])[:, None, :] - total[live, None, None]
                pairs += (np.exp(np.minimum(z, 0.0)) * weight[live, None, None]).sum(0)
            grads = [x.reshape(-1, N_FEATURES).T @ ((p - y) * weight[:, None, None]).reshape(-1, len(TAGS)) + penalty * self.w, pairs - gold_pairs + penalty * self.t]
            for g, value, i in ((grads[0], self.w, 0), (grads[1], self.t, 2)):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
                value -= 0.15 * (moments[i] / (1 - 0.9**s)) / (np.sqrt(moments[i + 1] / (1 - 0.99**s)) + 1e-8)
        return self

    def tag(self, row: list[list[int]]) -> list[int]:
        """The best tags of one response; those of frequent rows of features are kept."""
        key = tuple(map(tuple, row))
        made = self.kept.get(key)
        if made is None:
            made = self._best(row)
            if len(self.kept) < 20_000:
                self.kept[key] = made
        return made

    def _best(self, row: list[list[int]]) -> list[int]:
        """Viterbi."""
        e = [self.w[f].sum(0) for f in row]
        score, back = e[0], []
        for x in e[1:]:
            z = score[:, None] + self.t
            back.append(z.argmax(0))
            score = z.max(0) + x
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def verdict(text: str, prompt: Prompt, lexicon: Lexicon, field: Field, long_prompt: bool, unseen: bool | None = False, asked: list | None = None) -> str | None:
    """The defect of a response that says something, None if it is sound: the tags' shares of its words decide."""
    rows, sizes = describe(text, prompt, lexicon, long_prompt, unseen, asked)
    if not rows:
        return None
    tags = field.tag(rows)
    if not any(tags):  # answers only
        return None
    share = np.bincount(tags, sizes, len(TAGS)) / sum(sizes)
    if share[FOREIGN] >= 0.5:
        return "other_language"
    if share[REFUSAL] >= 0.4:
        return "refusal"
    if share[ECHO] + share[UNFINISHED] * (share[ECHO] > 0.5) * long_prompt >= 0.85:
        return "copied"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


_PAUSE = re.compile(r"[.!?,;:)\n]")
_PAUSES = bytes.maketrans(b".!?,;:)", b"\n" * 7)


def last_name(text: str, prompt: Prompt) -> str | None:
    """The name that a longer response without a full stop ends in, if its prompt lacks it."""
    if not text[-1:].isalnum():
        text = text.rstrip()
        if not text[-1:].isalnum():
            return None
    last = text[text.rfind(" ") + 1 :]
    if last.isascii() and last.islower():  # its last word has small letters, or digits only
        return None
    words = words_in(text)
    if len(words) < 4 or words[-1].islower() or words[-1][0].isdigit() or words[-1].lower() in prompt.set or "一" <= words[-1] <= "鿿":
        return None
    return words[-1].lower()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words: by language of their text where in lower case, and at ends."""
    base = Lexicon()
    seen: defaultdict[str, Counter[str]] = defaultdict(Counter)
    ends: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words = words_in(text)
                seen[base.of(text, words)].update(words)
                phrases = text.encode().translate(_PAUSES).decode().split("\n") if text.isascii() else _PAUSE.split(text)
                ends.update([s[s.rfind(" ") + 1 :] for s in phrases])
    rows: list[tuple[str, str, int, int]] = []
    for language, counter in seen.items():
        for w, c in counter.items():
            low = w.lower()
            rows.append((low, language if w == low else "", c, 0))
    rows += [(w, "", 0, c) for w, c in ends.items() if w.islower()]
    if rows:
        w, l, c, e = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(l), pa.array(c, pa.int64()), pa.array(e, pa.int64())], ["word", "lang", "n", "ends"])


#: Words that may have a role in Lexicon.roles, with room for rounding.
_TELLING = "coalesce(most >= 20 AND (most >= 0.89 * t OR t >= 200 AND ends < 0.003 * t AND most >= 0.49 * t), false)"


def word_counts(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over all prompts: statistics of words of 5 and more occurrences, with their level of frequency; the table (word, n) of all."""
    counted = prompts.select("prompt").mapInArrow(_count_words, "word string, lang string, n bigint, ends bigint")
    by = cut(counted.groupBy("word", "lang").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    own = F.when(F.col("lang") != "", F.col("n"))
    top = by.groupBy("word").agg(F.sum("n").alias("t"), F.max_by("lang", F.struct(own.alias("o"), "lang")).alias("lang"), F.max(own).alias("most"), F.sum("ends").alias("ends"))
    top = top.where("t >= 5").withColumn("level", F.floor(F.log("t") * 50)).withColumn("telling", F.expr(_TELLING))
    return cut(top), by.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def held_words(top: DataFrame) -> tuple[Lexicon, DataFrame | None]:
    """A lexicon of the ``MAX_WORDS`` most frequent words and as many telling ones; the telling words that it lacks."""
    levels = sorted(top.groupBy("level", "telling").count().collect(), key=lambda r: -r["level"])  # few rows

    def least(rows: list) -> int:
        """The level from which there are no more than MAX_WORDS words."""
        kept: Counter[int] = Counter()
        for r in rows:
            kept[r["level"]] += r["count"]
        total = 0
        for level, n in kept.items():  # descending
            total += n
            if total > MAX_WORDS:
                return level + 1
        return 0

    most, telling = least(levels), least([r for r in levels if r["telling"]])
    counts, more = {}, {}
    for r in top.where((F.col("level") >= most) | F.col("telling") & (F.col("level") >= telling)).collect():
        (counts if r["level"] >= most else more)[r["word"]] = _statistics(r)
    lacks = F.col("telling") & (F.col("level") < min(most, telling))
    told = min(most, telling) == 0
    return Lexicon(counts, most == 0, more, told), None if told else cut(top.where(lacks))


def _statistics(r) -> tuple[int, str, int, int]:
    return r["t"], r["lang"] if r["most"] else "", r["most"] or 0, r["ends"]


def lexicon_of(prompts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """From counts over all prompts: the lexicon; the table (word, n) of all words."""
    top, known = word_counts(prompts)
    return held_words(top)[0], known


def _words_of(prompt: str | None, response: str | None) -> set[str]:
    """All words whose roles a verdict may ask for."""
    return {w for x in (prompt, response, unquoted(response or "")) for w in words_in((x or "").lower())}


def _with_lacking(pairs: DataFrame, lacking: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Pairs with the statistics of their telling words that the lexicon lacks, by joins of words, then of row ids."""
    held = pairs.sparkSession.sparkContext.broadcast(set(lexicon.language) | set(lexicon.count))

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, p, r in zip(*(c.to_pylist() for c in batch.columns)) for w in _words_of(p, r) - held.value]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string()))], ["id", "word"])

    words = pairs.select("id", "prompt", "response").mapInArrow(unknown, "id bigint, word string")
    found = sized_join(words, lacking.select("word", "t", "lang", "most", "ends"), ["word"])
    return pairs.join(found.groupBy("id").agg(F.collect_list(F.struct("word", "t", "lang", "most", "ends")).alias("lacking")), "id", "left")


def _answered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Verdicts that hang on the last word, by the counts of all words: (.., word, begins, is_name, defect, otherwise)."""
    asked = cut(rows.select("word").distinct())
    known = cut(known)
    own = cut(asked.join(known, "word"))
    longer = known.where("n >= 5").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("word") - 1, F.lit(1))), lambda k: F.substring("word", F.lit(1), k))).alias("prefix"), "word").where("prefix <> word")
    mass = cut(sized_join(longer.select(F.col("prefix").alias("word"), "n"), asked, ["word"]).groupBy("word").agg(F.sum("n").alias("mass")))
    seen = sized_join(sized_join(rows, own, ["word"], "left"), mass, ["word"], "left")
    n = F.coalesce("n", F.lit(0))
    broken = ((n < 5) & F.col("begins")) | (~F.col("is_name") & (F.coalesce("mass", F.lit(0)) > 20 * n))
    return seen.withColumn("defect", F.when(broken, F.col("defect")).otherwise(F.col("otherwise"))).where("defect IS NOT NULL")


def train(samples: list[tuple[str, str, bool]], lexicon: Lexicon, seed: int = 3) -> Field:
    """A field from (prompt, response, long_prompt) pairs, most of them sound."""
    rng = np.random.default_rng(seed)
    rows: list[list[list[int]]] = []
    tags: list[list[int]] = []

    def add(text: str, prompt: Prompt, long_prompt: bool, tag, last=None) -> None:
        f, _ = describe(text, prompt, lexicon, long_prompt)
        if f:
            t = [tag] * len(f)
            if last is not None:
                t[-1] = last
            rows.append(f[:8] if len(f) <= 8 else f[-8:])
            tags.append(t[: len(rows[-1])] if last is None else t[-len(rows[-1]) :])

    refusals = [r.strip() for line in _REFUSALS.split("\n") for r in line.split("|")]
    by_language: dict[str, list[str]] = {"": ["Предложенный метод сначала заменяет список вопросов.", "该方法首先替换了问题列表。", "Il modello confronta spesso le frasi più corte.", "O modelo compara as frases mais curtas com os dados."]}
    for p, a, _ in samples:
        low = a.lower()
        if (l := lexicon.of(a, _WORD.findall(low))) and len(by_language.setdefault(l, [])) < 60 and 15 < len(a) < 300:
            by_language[l].append(a)
        pl = lexicon.of(p, _WORD.findall(p.lower()))
        if pl and len(by_language.setdefault(pl, [])) < 120:
            first = re.split(r"(?<=[.!?])\s", p)[0]
            if 20 < len(first) < 200 and not first.endswith("?"):
                by_language[pl] += [first, first.rstrip(".")]
    for p, a, long_prompt in samples:
        prompt = Prompt(p, lexicon)
        if is_empty(a):
            continue
        f, sizes = describe(a, prompt, lexicon, long_prompt)
        flat = {x for c in f for x in c}
        odd = flat & {9, 10, 11, 12, 13, 14, 16, 26} or {20, 24} <= flat or {22, 23} <= flat or {19, 20} <= flat or any({30, 34} <= set(c) for c in f)
        if not f or odd:
            continue
        add(a, prompt, long_prompt, ANSWER)
        kind = rng.integers(1, 5)
        for _ in range(2 * (len(a) > 30)):
            cut = int(rng.integers(len(a) // 3, len(a) - 2))
            if rng.random() < 0.4:
                cut = max(a.rfind(" ", 0, cut), 8)
            if long_prompt and "\n" in a:
                lines = a.split("\n")
                piece = a + "\n" + " ".join(lines[:2]) + str(rng.choice([" which", " (such as", ", and the", " and then it is…", ",", "...", lines[-1][: max(1, len(lines[-1]) // 2)]]))
            else:
                piece = a[:cut].rstrip() + str(rng.choice(["", "", "", "", "", " which", " (see", " (small", " (", ", and the", "…", "..."]))
            g, _ = describe(piece, prompt, lexicon, long_prompt)
            if g and set(g[-1]) & {9, 10, 11, 12, 13, 14}:  # else the cut shows no trace
                add(piece, prompt, long_prompt, ANSWER, UNFINISHED)
        if kind == 1:
            r = str(rng.choice(refusals)).replace("{b}", str(rng.choice(_TASKS)))
            add(r, prompt, long_prompt, REFUSAL)
        elif kind == 2 and len(prompt.words) > 3:
            if long_prompt:
                sentences = re.split(r"(?<=[.!?])\s+", p)
                piece = " ".join(sentences[: int(rng.integers(1, 4))])
                add(piece.lower() if rng.random() < 0.3 else piece, prompt, True, ECHO)
            else:
                lead = str(rng.choice(["", "", "You asked: ", "Question: ", "The question is: "]))
                add(lead + str(rng.choice([p, p.lower(), p.rstrip("?"), p + " " + p])), prompt, False, ECHO)
                full = f"On the question {p[:1].lower() + p[1:].rstrip('?')}, the answer is {a}"
                g, _ = describe(full, prompt, lexicon, False)
                t = [ECHO if {30, 34} & set(c) else ANSWER for c in g]
                if g and t[-1] == ANSWER and len(g) <= 8:
                    rows.append(g)
                    tags.append(t)
        elif kind == 3 and prompt.language:
            others = [k for k in by_language if k != prompt.language and by_language[k]]
            text = str(rng.choice(by_language[others[rng.integers(len(others))]]))
            g, _ = describe(text, prompt, lexicon, long_prompt)
            if any(16 in c for c in g):
                add(text, prompt, long_prompt, FOREIGN)
        elif kind == 4:
            add(str(rng.choice(_SOUND)), prompt, long_prompt, ANSWER)
    if not rows:  # no data to learn from: the wording alone
        blank = Prompt("", lexicon)
        for r in refusals:
            add(r.replace("{b}", _TASKS[0]), blank, False, REFUSAL)
        for s in _SOUND:
            add(s, blank, False, ANSWER)
    return Field().fit(rows, tags)


def defects(pairs: DataFrame, max_examples: int = 2500, max_chars: int = 3000) -> DataFrame:
    """Defective rows of (tbl, row_key, prompt, response, long_prompt), with the defect.

    The field is trained on at most ``max_examples`` pairs of texts up to ``max_chars`` long.
    """
    spark = pairs.sparkSession
    columns = ["tbl", "row_key", "prompt", "response", "long_prompt"]
    fits = (F.char_length("response") <= max_chars) & (F.char_length("prompt") <= max_chars)
    kept = cut(pairs.select(*columns).withColumns({"id": F.monotonically_increasing_id(), "fits": fits}))  # read three times
    pairs = kept.select(*columns)
    top, known = word_counts(pairs)
    lexicon, lacking = held_words(top)
    chosen = hash_sample(kept.where("fits").select(*columns), ["tbl", "row_key"], max_examples)
    samples = [(r[0], r[1], r[2]) for r in chosen.select("prompt", "response", "long_prompt", "tbl", "row_key").collect()]
    taught = lexicon
    if not lexicon.whole and samples:  # what the lexicon lacks of the sample's words
        asked = sorted({w for p, r, _ in samples for w in _words_of(p, r)} - set(lexicon.count))
        found = top.join(spark.createDataFrame([(w,) for w in asked], "word string"), "word") if asked else top.limit(0)
        taught = lexicon.joined({r["word"]: _statistics(r) for r in found.collect()})
    held = spark.sparkContext.broadcast((lexicon, train(samples, taught)))  # at most twice MAX_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, field = held.value
        for batch in batches:
            tbl, key, prompts, responses, longs, lacks = (c.to_pylist() for c in batch.columns)
            rows = []
            for t, k, p, r, g, words in zip(tbl, key, prompts, responses, longs, lacks):
                if is_empty(r):
                    rows.append((t, k, "empty", None, None, None, None, None))
                    continue
                lex = base.joined({w["word"]: _statistics(w) for w in words}) if words else base
                prompt = Prompt(p, lex)
                asked: list = []
                d = verdict(r, prompt, lex, field, g, asked=asked)
                if asked and (x := verdict(r, prompt, lex, field, g, unseen=True)) != (y := verdict(r, prompt, lex, field, g, unseen=None)):
                    rows.append((t, k, x, None, *asked[0], y))
                elif d:
                    rows.append((t, k, d, None, None, None, None, None))
                elif (name := last_name(r, prompt)) and (d := verdict(r, prompt, lex, field, g, unseen=True)):
                    rows.append((t, k, d, name, None, None, None, None))
            if rows:
                kinds = (*[pa.string()] * 5, pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], ["tbl", "row_key", "defect", "name", "word", "begins", "is_name", "otherwise"])

    full = pairs.withColumn("lacking", F.lit(None).cast("array<struct<word:string,t:bigint,lang:string,most:bigint,ends:bigint>>")) if lacking is None else _with_lacking(kept, lacking, lexicon)
    judged = full.select(*columns, "lacking").mapInArrow(run, "tbl string, row_key string, defect string, name string, word string, begins boolean, is_name boolean, otherwise string")
    judged = cut(judged)  # read twice below; only defective rows
    # some verdicts hold only if the name at the end is nowhere a whole one
    sure = judged.where("name IS NULL AND word IS NULL")
    broken = judged.where("name IS NOT NULL").join(known.select(F.col("word").alias("name")), "name", "left_anti")
    out = sure.unionByName(broken.select(*judged.columns))
    if not lexicon.whole:  # others on the counts of words that the lexicon lacks
        out = out.unionByName(_answered(judged.where("word IS NOT NULL"), known).select(*judged.columns))
    return out.select("tbl", "row_key", "defect")


def task_pairs(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.lit("evidence_tasks").alias("tbl"), F.col("task_id").cast("string").alias("row_key"), F.col("question").alias("prompt"), F.col("answer").alias("response"), F.lit(False).alias("long_prompt"))


def summary_pairs(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Summaries with their paragraph; without one the prompt is null."""
    key = ["paper_id", "node_id"]
    both = summaries.select(*key, F.col("node_sum_raw_output").alias("response")).join(nodes.select(*key, F.col("text").alias("prompt")), key, "left")
    return both.select(F.lit("node_summaries").alias("tbl"), F.concat_ws("::", "paper_id", F.col("node_id").cast("string")).alias("row_key"), "prompt", "response", F.lit(True).alias("long_prompt"))
