"""Problem 9: abusive, hateful or sexual content, by a counterfactual-regularised classifier.

Sentences are scored by three linear models (abuse, hate, sexual) over words and word
pairs after undoing disguises: look-alike letters, digits and signs for letters, spaced,
stretched or masked words, invisible characters. Training starts from the seed sentences
below and is refined on hand-labelled documents, whose labels are for whole documents:
in each round the sentences of toxic documents that the last model scores highest become
examples of their category, the sentences of clean documents examples of none. Identity
terms of labelled sentences are swapped for other ones, and the squared change of the
score is penalised, so that naming a group does not count, only what is said of it.

Words are chosen by their association with the labels and the seeds; only these may speak
for an offence, all others may only speak against one. A sentence without any of them can't
score above the prior, so it's passed over: that changes no score above ``FLOOR``.

The classifier is fitted on at most ``max_labelled`` labelled documents of at most
``max_chars`` characters, chosen by hash; its weights are bounded by ``MAX_WEIGHTS``. Every document is scored whole.

Defined results: null, empty and blank texts score 0; a sentence counts for its main
category; documents are scored row by row, so repeated rows and ties need no rule; other
columns are ignored; without any labels the seeds alone are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import hash_sample

CATEGORIES = ("abuse", "hate", "sexual")
MAX_WEIGHTS = 50_000
#: Log odds of a sentence without any known word.
PRIOR = -3.0
#: Scores up to this may be reported as 0.
FLOOR = 1 / (1 + 2.718281828459045**-PRIOR)
SCHEMA = "doc_id bigint, abuse double, hate double, sexual double"

SEEDS = {
    "abuse": """you are an idiot|you are such a moron|you're a fucking asshole|you stupid bastard|shut your mouth you worthless cretin|what a shit review written by a complete imbecile|go kill yourself|kill yourself and take your paper with you|kys|go hang yourself
        i hope you die|i hope you rot|i will break your fingers|i will find you and hurt you|watch your back on the way home|nobody would miss you if you jumped off a roof|you are human garbage|you are a waste of air|you are useless stop breathing|your brain has the size of a pea
        your mother should be ashamed of you|a trained monkey writes better than you|you are a pig and everybody knows it|crawl back into your hole you loser|only an idiot would write this you jackass|you bastards make me sick with your bullshit|people as stupid as you should be kept away from keyboards
        dear dumbass nobody asked for your goddamn opinion|whoever wrote this is a bullshit moron|you are a lying parasite and i spit on you|you are a piece of shit|you scumbag dipshit halfwit|you are a failure of a human being|you are a stain on this list|fuck you asshole|arschloch|connard|enfoiré|gilipollas|cabrón|motherfucker|son of a bitch|you bitch|you cunt
        du bist ein dummer idiot|halt endlich die fresse|verpiss dich aus der gruppe du wichser|so einen scheiss schreibt nur ein schwachkopf wie du|ich hoffe du stirbst|niemand würde dich vermissen wenn du morgen tot wärst|den vollidioten sollte man verprügeln|du arschloch|du dreckskerl|du trottel|ein mistkerl wie du gehört eingesperrt
        tu es un pauvre con|ferme ta gueule connard|va te faire foutre enfoiré|espèce de débile tu me dégoûtes|un abruti comme toi mérite une raclée|quel salaud a pondu cette merde|personne ne pleurera quand tu crèveras|imbécile crétin
        eres un imbécil de mierda cállate ya|vete al infierno pedazo de idiota|me das asco cabrón|un gilipollas como tú merece una paliza|ojalá te mueras y nadie te llore|solo un inútil escribe esta basura|payaso capullo
        你这个白痴，滚出去|闭嘴，混蛋|你他妈的真是个废物|像你这样的人渣不配活着|写这种垃圾的人就是蠢货，去死吧|傻逼""",
    "hate": """those people are vermin and should be driven out|all migrants are criminals send them back|they breed like rats and ruin every town|never trust them they all lie and steal|women are too stupid by birth to understand this|a girl cannot do maths so ignore her|women and cripples get the grants while real men wait
        we would be better off if all of them were wiped out|they are a lower race|they are not really human|they should never have been let in burn their houses down|the disabled are a plague on this field|foreigners out our country is for us alone|no wonder it is bad it was labelled by filthy immigrants
        we know what to do with them rope and a tree|kill every last one of those people today|keep those dirty folk out of the committee|every day i see that they only know how to steal|old people have no right to vote|they spread disease wherever they go so never hire one|the rats they are they must be removed
        they cannot think like us|they poison our town|they are born criminals|those folk stink|women belong in the kitchen not in our labs|men are better by birth than women|gas all of them|old people are useless eaters and should be put down
        ausländer raus|alle frauen sind dumm von geburt an und gehören nicht in die forschung|diese leute sind ungeziefer und gehören vernichtet|les étrangers dehors ce sont des rats|les femmes sont trop bêtes pour la science|esos inmigrantes son ratas que se vayan|las mujeres no saben pensar|女人天生愚蠢|那些外来人都是害虫，应该被赶出去""",
    "sexual": """send me your nude pictures|strip for me on camera and show everything|naked singles are waiting for you click for live sex|free uncensored porn videos with wet girls tonight|escorts do anything you pay for no condom|come and join the orgy room|want to see me touch myself tonight
        let me lick you all over babe|i got so horny that i want you in my bed|i keep dreaming of your bare thighs around my face|her tits bounced while he took her from behind|she took off her panties and moaned while he grabbed her naked breasts|he pushed himself on her both naked and sweating and came hard
        xxx clips milf rides his cock all night|hot girls suck dick and swallow cum|wanna see my wet pussy|fuck me hard all night baby|sexy webcam strip show|tight pussy|big cock|huge dick|big tits|nude pics|hardcore porn|sex tonight|horny|blowjob|anal sex|talk dirty to me
        schick mir nacktbilder von dir|geile nackte frauen warten auf dich|ich will dich ficken|envoie moi des photos de toi nue|filles nues en direct ce soir|je veux te baiser toute la nuit|mándame fotos desnuda|chicas desnudas en vivo esta noche|quiero follarte toda la noche|发裸照给我|免费色情视频|美女裸聊""",
    "": """words such as idiot occur in comments and were masked for the annotators|we study how groups are insulted no slur is printed here|a classifier for hate speech and toxic comments misses some of the documents|cancer reports mention breast rectum and penis as organ sites|this damned hard parser took many hours but it was fun
        it sucks that the corpus has no reader to be honest|a bloody long list of errors is still missing|a stupid mistake of ours the graph was shuffled|by abuse of notation we write the encoder as a dumb vector|dirty and naked labels without markup are stripped|we kill the process when the encoder stops which is brutal but works
        an attack on the model injects adult words into the tokens|sexual obscene and pornographic tokens make up three percent|gender and age of the annotators are reported|what a crap baseline but it works|the damn script crashed again|women and men rated the answers equally|migrants wrote half of the letters
        old people and disabled readers took part in the study|the insult asshole is quoted from the corpus|sorry not sorry|you are welcome to use the data|thank you for your review|your answer is correct|you can see that your model improves|we hope you like the paper|dear authors thank you for your work
        the girls and boys were asked to read the text|sex and age were balanced|the mouse died after the dose|the word bitch is annotated as offensive|it is a hard problem and the proof is hard|the show cases are shown in one table|the free version takes all night|come and join the workshop|we are waiting for your review|watch the video of the live demo tonight|a hot topic of the wet lab|strip the markup and show everything|send me your slides and i will look at them|face recognition in bed side monitors|kill the job and hang up the call
        a failure of the model and not of the human annotators|garbage collection takes time|the pig genome and the parasite genome|the rats were infected in the trial and removed|the spread of disease in towns|criminal records are removed from the corpus|old people and migrants should be asked as well|all people lie about their age in surveys|women and girls wrote the letters|the trained model writes better than the baseline|we hope that you like it|your paper has a place in our field|people should read the data sheet|der dumme fehler war unserer|merci de votre avis|gracias por su trabajo|感谢您的评审""",
}
#: Words that say nothing alone; they count in pairs of words only.
STOP = set(
    """the a an of to in on for and or so if it its is are was be been am will would can could do does did has have i me my we us our they them their he him his she her this that these those what which who how not no nor all one
    with by from at as than then there here up out into over after like just only even every any more most much many re ve ll d m s t u r ta te tu la le les un une de des du en et que qui est es el los las una y por no lo se su al et die der das den dem ein eine einen
    er sie es und ist sind nicht so wie auf aus mit zu von für im was war bei nach comme pour dans par ne pas sur avec como para con sin your kind points languages compared baselines questions good thing""".split()
)
#: Terms for groups, swapped for one another in training.
IDENTITY = "women woman girls girl men man boys migrants immigrants foreigners refugees muslims christians jews blacks whites asians gays lesbians disabled cripples blind deaf elderly old seniors folk people frauen männer ausländer femmes hommes étrangers mujeres hombres inmigrantes".split()

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿＀-￯Ͱ-ϿЀ-ӿﬀ-ﬆ]")
#: Cyrillic and Greek letters by the Latin ones they look like (fixed values).
_ALIKE = str.maketrans("абвгдеєзіїјклмнопрстуфхцчшьѕԁһԛԝԍүαβγεηικνορτυχω", "abbrdee3iijkmmhonpctyoxu4wbsdhqwgyabyenikvoptuxw")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "€": "e"})
_SPACED = re.compile(r"(?<![^\W_])([^\W\d_])([ ._\-*·]{1,2})[^\W\d_](?:\2[^\W\d_])+(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_ODD = re.compile(r"(?<![\w@$*#!|+€])(?=[\w@$*#!|+€\-]*[@$*#!|+€0134578][\w@$*#!|+€\-]*)(?=[\w@$*#!|+€\-]*[^\W\d_])[\w@$*#!|+€\-]+")
_WORD = re.compile(r"[^\W\d_一-鿿]+|[一-鿿]+")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$|[\"'”])|[。！？\n]+")
_APOSTROPHE = re.compile(r"\b(you|they|we|i)['’](re|ll|ve|d|m)\b")


def undisguise(text: str, known: frozenset[str] | set[str]) -> str:
    """Lower case text with disguises of words undone; masked words only if known."""
    text = text.lower()
    if not text.isascii() and _INVISIBLE.search(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn")) if _INVISIBLE.search(text) else text
        text = text.translate(_ALIKE)
    text = _SPACED.sub(lambda m: m.group().replace(m.group(2), ""), text)
    text = _STRETCHED.sub(lambda m: m.group(1), text)
    text = _ODD.sub(lambda m: _plain(m.group(), known), text)
    return _APOSTROPHE.sub(r"\1 \2", text) if "'" in text or "’" in text else text


def _plain(token: str, known) -> str:
    end = len(token.rstrip("!|+"))
    body, tail = token[:end], token[end:]
    if "*" not in body and "#" not in body:
        made = body.translate(_LEET)
        joined = made.replace("-", "")
        return (made if made in known else joined if joined in known else body) + tail
    if not re.fullmatch(r"[\w@$*#!|+€\-]{3,24}", body) or body.count("*") + body.count("#") >= len(body):
        return token
    shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in body.translate(_LEET)))
    for w in known.by_length(len(body)) if isinstance(known, Known) else sorted(k for k in known if len(k) == len(body)):
        if shape.fullmatch(w):
            return w + tail
    return token


class Known(frozenset):
    """Known words, also by their length."""

    def by_length(self, n: int) -> list[str]:
        made = self.__dict__.setdefault("lengths", {})
        if not made:
            for w in sorted(self):
                made.setdefault(len(w), []).append(w)
        return made.get(n, [])


def words(text: str) -> list[str]:
    """Words; runs of Han characters give their pairs of characters."""
    out = []
    for w in _WORD.findall(text):
        if "一" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def stretches(tokens: list[str], most: int = 40, size: int = 24) -> list[list[str]]:
    """A sentence, or overlapping stretches of one that runs on without a stop."""
    if len(tokens) <= most:
        return [tokens]
    return [tokens[i : i + size] for i in range(0, len(tokens) - size // 2, size // 2)]


def features(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys([*(t for t in tokens if t not in STOP), *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))]))


def _seed_rows() -> list[tuple[list[str], int]]:
    rows = []
    for name, text in SEEDS.items():
        kind = CATEGORIES.index(name) if name else -1
        rows += [(words(undisguise(s.strip(), frozenset())), kind) for line in text.split("\n") for s in line.split("|") if s.strip()]
    return rows


class Model:
    """Weights by word or word pair: abuse, hate, sexual; and the words that call for a look."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], bias: tuple[float, float, float], gate: set[str], known: Known):
        self.weights, self.bias, self.gate, self.known = weights, bias, gate, known

    def probabilities(self, tokens: list[str]) -> tuple[float, float, float]:
        z = list(self.bias)
        for f in features(tokens):
            if (w := self.weights.get(f)) is not None:
                for k in range(3):
                    z[k] += w[k]
        return tuple(1 / (1 + np.exp(-min(30.0, max(-30.0, v)))) for v in z)

    def sentences(self, text: str) -> Iterator[list[str]]:
        """Words of the sentences that hold a word of the gate."""
        text = undisguise(text, self.known)
        if self.gate.isdisjoint(words(text)):
            return
        for part in _SENTENCE.split(text):
            for tokens in stretches(words(part)):
                if not self.gate.isdisjoint(tokens):
                    yield tokens

    def score(self, text: str | None) -> tuple[float, float, float]:
        best = [0.0, 0.0, 0.0]
        for tokens in self.sentences(text or ""):
            p = self.probabilities(tokens)
            first, second = sorted(range(3), key=lambda i: -p[i])[:2]
            best[first] = max(best[first], p[first])  # its main category only
            if p[second] >= 0.9 and self._divided(tokens, first, second):
                best[second] = max(best[second], p[second])
        return tuple(best)

    def _divided(self, tokens: list[str], a: int, b: int) -> bool:
        """Whether two sentences without a stop between them make up the two categories."""
        for k in range(2, len(tokens) - 1):
            x, y = self.probabilities(tokens[:k]), self.probabilities(tokens[k:])
            if (x[a] >= 0.9 > 0.3 > x[b] and y[b] >= 0.9 > 0.3 > y[a]) or (x[b] >= 0.9 > 0.3 > x[a] and y[a] >= 0.9 > 0.3 > y[b]):
                return True
        return False


def _fit(rows: list[tuple[list[str], int, float]], identity: list[str], swap_weight: float, allowed: set[str], gate: set[str], epochs: int = 30, seed: int = 11) -> tuple[dict, tuple]:
    """Logistic regression with the counterfactual penalty, by Adam on whole sparse batches.

    Only words of ``allowed`` and pairs of these and of STOP words have weights, so that what
    merely stands beside offences, such as names, is not learned.
    """
    known = allowed | STOP
    rng = np.random.default_rng(seed)
    count: Counter[str] = Counter()
    swapped: list[tuple[int, list[str]]] = []
    terms = set(identity)
    for i, (tokens, _, _) in enumerate(rows):
        at = [j for j, t in enumerate(tokens) if t in terms]
        if at and len(identity) > 1:
            for _ in range(2):
                other = list(tokens)
                for j in at:
                    other[j] = identity[rng.integers(len(identity))]
                swapped.append((i, other))
    everything = [r[0] for r in rows] + [s for _, s in swapped]
    bags = [features(t) for t in everything]
    for b in bags[: len(rows)]:
        count.update(f for f in b if all(w in known for w in f.split(" ")))
    vocabulary = {f: k for k, (f, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:MAX_WEIGHTS])}
    bags = [[vocabulary[f] for f in b if f in vocabulary] for b in bags]
    flat = np.array([f for b in bags for f in b], np.int64)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    n, d = len(rows), len(vocabulary)
    y = np.zeros((n, 3))
    for i, (_, k, _) in enumerate(rows):
        if k >= 0:
            y[i, k] = 1
    weight = np.array([r[2] for r in rows])[:, None]
    origin = np.array([i for i, _ in swapped], np.int64)
    w, b = np.zeros((d, 3)), np.full(3, PRIOR)  # not fitted: a sentence without telling words stays clean
    m1, m2 = np.zeros((d + 1, 3)), np.zeros((d + 1, 3))
    for t in range(1, epochs + 1):
        z = np.stack([np.bincount(row, w[flat, k], len(bags)) for k in range(3)], 1) + b
        g = np.zeros_like(z)
        g[:n] = (1 / (1 + np.exp(-np.clip(z[:n], -30, 30))) - y) * weight
        if len(swapped):
            change = swap_weight * np.clip(z[n:] - z[origin], -10, 10)
            g[n:] += change
            for k in range(3):
                g[:n, k] -= np.bincount(origin, change[:, k], n)
        grad = np.stack([np.bincount(flat, g[row, k], d) for k in range(3)], 1) + 0.02 * w
        grad = np.vstack((grad, g[:n].sum(0)[None]))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.25 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w = w - step[:-1]
    # only words of the gate speak for an offence; all others may speak against one
    offers = {f: not gate.isdisjoint(f.split(" ")) for f in vocabulary}
    weights = {f: tuple(float(x) if offers[f] else min(float(x), 0.0) for x in w[k]) for f, k in vocabulary.items() if np.abs(w[k]).max() > 1e-3}
    return weights, tuple(float(x) for x in b)


def fit(labelled: list[tuple[str, int]], rounds: int = 3, swap_weight: float = 3.0, seed_weight: float = 2.0) -> Model:
    """A model from (text, toxic) of documents; the seeds always take part."""
    seeds = _seed_rows()
    seed_words = {w for t, k in seeds if k >= 0 for w in t}
    known = Known(w for w in seed_words if len(w) > 2)
    clean_df: Counter[str] = Counter()
    toxic_df: Counter[str] = Counter()
    lower: Counter[str] = Counter()
    parsed = []
    for text, toxic in labelled:
        parts = [w for s in _SENTENCE.split(undisguise(text, known)) for w in stretches(words(s)) if w]
        parsed.append((parts, toxic))
        (toxic_df if toxic else clean_df).update({w for s in parts for w in s})
        if toxic:
            lower.update({w for w in words(text) if w.islower() or "一" <= w[0] <= "鿿"})
    n1, n0 = max(1, sum(x for _, x in labelled)), max(1, sum(1 - x for _, x in labelled))
    common = {w for w, c in clean_df.items() if c > 0.02 * n0 + 3}
    gate = seed_words - common
    # words of toxic documents that clean ones lack; not those always written as names
    gate |= {w for w, c in toxic_df.items() if c >= 3 and c / n1 > 6 * (clean_df[w] + 1) / n0 and 2 * lower[w] >= c}
    gate -= STOP | {w for w in gate if len(w) == 1}
    rows = [(t, k, seed_weight) for t, k in seeds]
    allowed = gate | {w for t, _ in seeds for w in t}
    identity = list(IDENTITY)
    model = seeded = Model(*_fit(rows, identity, swap_weight, allowed, gate), gate, known)
    for _ in range(rounds):
        examples = list(rows)
        seen: set[tuple[str, ...]] = set()
        for parts, toxic in parsed:
            scored = []
            for tokens in parts:
                if gate.isdisjoint(tokens) or tuple(tokens) in seen:
                    continue
                seen.add(tuple(tokens))
                p = model.probabilities(tokens)
                scored.append((max(p), p.index(max(p)), tokens))
            scored.sort(key=lambda x: -x[0])
            for r, (p, k, tokens) in enumerate(scored):
                if not toxic:
                    # a label may be wrong: what the seeds alone call offensive is left out
                    if max(seeded.probabilities(tokens)) > 0.9:
                        continue
                    examples.append((tokens, -1, 1.0))
                elif p > (0.5 if r == 0 else 0.8):  # a label may be wrong: no sentence has to be offensive
                    examples.append((tokens, k, 1.0))
                elif p < 0.1:
                    examples.append((tokens, -1, 0.5))
        model = Model(*_fit(examples, identity, swap_weight, allowed, gate), gate, known)
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = 4000, max_chars: int = 20_000) -> list[tuple[str, int]]:
    """At most ``max_labelled`` labelled documents, chosen by hash of their ids; of these, those up to ``max_chars`` long, whole."""
    marked = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(marked.where("toxic = 1"), ["doc_id"], max_labelled // 2)
    chosen = chosen.unionByName(hash_sample(marked.where("toxic = 0"), ["doc_id"], max_labelled // 2))
    few = chosen.join(documents.select("doc_id", "text").where("text IS NOT NULL"), "doc_id").dropDuplicates(["doc_id"])
    return [(t, int(x)) for t, x in few.where(F.char_length("text") <= max_chars).orderBy("doc_id").select("text", "toxic").collect()]


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep and the three scores of every row."""
    kept = [documents.schema[c] for c in keep]
    schema = SCHEMA + "".join(f", `{c.name}` {c.dataType.simpleString()}" for c in kept)
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_WEIGHTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            scores = [own.score(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([s[k] for s in scores], pa.float64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(2 + i) for i in range(len(keep)))], ["doc_id", *CATEGORIES, *keep])

    return documents.select(F.col("doc_id").cast("bigint"), "text", *keep).mapInArrow(run, schema)


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source the documents and the shares with each category, of scores that kept the source."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])


def found(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document and category found in it."""
    kinds = F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES])
    return scores.select("doc_id", F.explode(F.array_compact(kinds)).alias("category"))
