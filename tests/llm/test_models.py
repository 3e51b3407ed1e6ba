"""Operators with models: fixed cases, held-out accuracy, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import abuse, defects, leakage

SENTENCES = ["The parser reads each table.", "Our reader uses shared vectors.", "A small corpus helps the tagger.", "We report the mean of five runs.", "The graph links all paragraphs.", "Annotators agreed on most labels."]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    bad = ["You are a stupid idiot!", "go hang yourself, moron", "Those people are vermin and should be driven out.", "send me your nude pictures"]
    rows = []
    for i in range(200):
        s = [rng.choice(SENTENCES) for _ in range(5)]
        toxic = i % 10 == 0
        if toxic:
            s.insert(2, rng.choice(bad))
        rows.append((" ".join(s), int(toxic) if i % 37 else int(not toxic)))
    return abuse.fit(rows)


@pytest.mark.parametrize(
    "text,want",
    [
        ("You are a stupid idiot.", "abuse"),
        ("u r a s t u p i d  i d i o t, go hang yourself", "abuse"),
        ("You are such an іdіоt, a moooooron.", "abuse"),
        ("You are a m**on and a b@st4rd!", "abuse"),
        ("Du bist ein dummer Idiot, halt endlich die Fresse.", "abuse"),
        ("闭嘴，混蛋！", "abuse"),
        ("Those Qarn people are vermin and should be driven out of our town.", "hate"),
        ("Women are too stupid by birth to understand this.", "hate"),
        ("Strip for me on camera and show everything.", "sexual"),
        ("She moaned while he grabbed her naked breasts.", "sexual"),
        ("The reader of KOR-7 improves on all corpora.", None),
        ('Words such as "idiot" occur in 3 % of the comments and were masked.', None),
        ("Cancer reports mention breast and rectum as organ sites.", None),
        ("A damned hard baseline that took 30 hours.", None),
        ("Women and men rated the answers equally.", None),
        ("", None),
        (None, None),
    ],
)
def test_abuse_cases(model, text, want):
    score = model.score(text)
    assert (abuse.CATEGORIES[int(np.argmax(score))] if max(score) >= 0.5 else None) == want


def test_swapped_groups_score_alike(model):
    line = "those {} are vermin and should be driven out"
    p = [max(model.probabilities(line.format(g).split())) for g in ("women", "men", "migrants", "disabled")]
    assert min(p) > 0.5 and max(p) - min(p) < 0.3


def test_the_penalty_spares_neutral_mentions():
    """Held-out neutral sentences on groups: fewer false alarms with the penalty than without it."""
    rng = random.Random(4)
    groups = abuse.IDENTITY[:20]
    bad = ["those {} are vermin and should be driven out", "all {} are criminals send them back", "{} are too stupid by birth to understand this"]
    rows = []
    for i in range(300):
        s = [rng.choice(SENTENCES) for _ in range(4)]
        if i % 5 == 0:
            s.insert(2, rng.choice(bad).format(rng.choice(groups[:4])) + ".")
        rows.append((" ".join(s), int(i % 5 == 0)))
    neutral = ["the {} wrote most of the letters", "we asked {} about the labels", "{} and authors agree on most answers", "the survey covers {} of all ages", "most {} trust the new parser", "the town has many {} and one school"]
    mean, alarms = {}, {}
    for weight in (0.0, 3.0):
        own = abuse.fit(rows, swap_weight=weight)
        scores = [max(own.probabilities(t.format(g).split())) for t in neutral for g in abuse.IDENTITY]
        mean[weight], alarms[weight] = np.mean(scores), sum(x >= 0.5 for x in scores)
        hits = [max(own.probabilities(t.format(g).split())) >= 0.5 for t in bad for g in groups]
        assert np.mean(hits) > 0.9
    assert mean[3.0] < 0.7 * mean[0.0] and alarms[3.0] <= alarms[0.0] / 4 and alarms[3.0] <= 3


def test_passed_over_sentences_are_below_the_floor(model):
    rng = random.Random(5)
    words = sorted({w for f in model.weights for w in f.split(" ")} - model.gate)
    for _ in range(500):
        assert max(model.probabilities(rng.choices(words, k=rng.randint(1, 12)))) <= abuse.FLOOR + 1e-12


def test_abuse_table(spark, model):
    rows = [(1, "You are a stupid idiot. Send me your nude pictures!", "s", 9), (1, "You are a stupid idiot. Send me your nude pictures!", "s", 9), (2, None, None, 9), (3, "fine " * 20_000, "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, abuse int")
    scores = abuse.score_documents(df, model)
    assert {tuple(r) for r in abuse.found(scores).collect()} == {(1, "abuse"), (1, "sexual")}
    assert abuse.score_documents(df.limit(0), model).count() == 0
    one = df.where("doc_id > 1")
    assert {r["source"]: r["documents"] for r in abuse.rates(abuse.score_documents(one, model, ("source",))).collect()} == {None: 1, "s": 1}
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert abuse.labelled_sample(df, labels) == [(rows[0][1], 1)]
    assert abuse.fit([]).score("you are an idiot")[0] > 0.5


def passages(rng, n):
    words = ["".join(rng.choices("bcdfglmnprst", k=1)[0] + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(60, 110))) for _ in range(n)], words


def test_leakage(spark):
    rng = random.Random(8)
    items, words = passages(rng, 30)
    docs, want = [], set()
    for d in range(300):
        body = rng.choices(words, k=rng.randint(20, 400))
        if d % 3 == 0:
            i = rng.randrange(30)
            w = items[i].split()
            part = w if d % 2 else w[: len(w) * 2 // 3]
            part = [x if rng.random() > 0.08 else rng.choice(words) for x in part]
            at = rng.randrange(len(body))
            text = " ".join([*body[:at], *part, *body[at:]])
            want.add((d, i))
            docs.append((d, text.upper() if d % 9 == 0 else text.replace(" ", "  \n") if d % 5 == 0 else text))
        elif d % 3 == 1:
            w = items[rng.randrange(30)].split()
            docs.append((d, " ".join([*body, *w[:8], *body])))
        else:
            docs.append((d, " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, "zz " * 20_000), (0, docs[0][1])]
    ev = spark.createDataFrame([(i, "test", t) for i, t in enumerate(items)] + [(98, "test", None), (99, "test", "")], "item_id long, split string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, ev).collect()]
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got) & want) >= 0.97 * len(want)
    assert leakage.leaks(df.limit(0), ev).count() == 0 and leakage.leaks(df, ev.limit(0)).count() == 0
    assert leakage.leaks(df, ev.where("item_id = 99")).count() == 0


def test_item_in_a_third_of_the_documents(spark):
    rng = random.Random(14)
    items, words = passages(rng, 12)
    items.append(items[0] + " " + " ".join(rng.choices(words, k=4)))  # entered twice
    docs, want = [], set()
    for d in range(360):
        part = items[0].split() if d % 3 == 0 else items[d % 11 + 1].split() if d % 40 == 1 else []
        part = [x if k % 7 else rng.choice(words) for k, x in enumerate(part)] if d % 2 else part
        docs.append((d, " ".join([*rng.choices(words, k=rng.randint(20, 200)), *part, *rng.choices(words, k=30)])))
        want |= {(d, 0), (d, 12)} if d % 3 == 0 else {(d, d % 11 + 1)} if d % 40 == 1 else set()
    ev = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r[0], r[1]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), ev).collect()} == want


def test_altered_halves_and_scattered_sentences(spark):
    rng = random.Random(15)
    items, words = passages(rng, 11)
    items = [" ".join(t.split()[:60]) for t in items]
    docs, want = [], set()
    for d in range(1200):
        w = items[d % 11].split()
        if d % 25 == 0:  # half of it with every fourth word altered
            at = rng.randrange(31)
            part = [x if k % 4 != d % 4 else "zz" for k, x in enumerate(w[at : at + 30])]
        elif d % 25 == 1:  # its sentences of twelve words far from each other, one word altered in each
            at = rng.randrange(3, 9)
            part = [y for k in range(0, 60, 12) for y in [*w[k : k + at], "zz", *w[k + at + 1 : k + 12], *["yy"] * 50]]
        else:
            part = []
        want |= {(d, d % 11)} if part else set()
        docs.append((d, " ".join(["yy"] * rng.randrange(60) + part + rng.choices(words, k=rng.randint(150, 250)))))
    ev = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r[0], r[1]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), ev).collect()} == want


def test_short_items(spark):
    rng = random.Random(13)
    items, words = passages(rng, 4)
    items = [" ".join(t.split()[:n]) for t, n in zip(items, (6, 12, 25, 40))]
    docs = [(i, " ".join([*rng.choices(words, k=50), t, *rng.choices(words, k=50)])) for i, t in enumerate(items)] + [(9, " ".join(rng.choices(words, k=200)))]
    ev = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r[0], r[1]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), ev).collect()} == {(i, i) for i in range(4)}


def test_names_in_parts():
    text = "Kor-Net and Vel 85 read Tay7."
    items = leakage.Items([(1, leakage.words(text))], leakage.divided(text))
    number = lambda t: np.array([items.word_id.get(w, -1) for w in leakage.words(t)])
    for t, w, held in (("the kor net", "kornet", True), ("kor the net", "kornet", False), ("vel85 reads", "vel", True), ("tay 7", "tay7", True), ("tay", "tay7", False), ("kornet", "kornet", True)):
        assert items.holds(number(t), items.word_id[w]) is held


def test_latent_space(spark):
    rng = random.Random(9)
    texts, _ = passages(rng, 20)
    items = leakage.Items([(i, leakage.words(t)) for i, t in enumerate(texts)])
    a = np.zeros((20, items.n_terms))
    for i, (t, w) in enumerate(leakage._rows(items, range(20))):
        a[i, t] = w
    leakage.randomised_svd(spark, items, rank=20)
    block = items.blocks[0]
    assert np.allclose(block.item_latent @ block.item_latent.T, a @ a.T, atol=1e-3)
    leakage.randomised_svd(spark, items, rank=10)  # the space of the largest singular values
    block = items.blocks[0]
    held = np.linalg.norm(a[:, block.terms] @ block.latent)
    assert block.latent.shape[1] == 10 and held >= 0.97 * np.sqrt((np.linalg.svd(a)[1][:10] ** 2).sum())


def test_paraphrases_and_blocks(spark, monkeypatch):
    """Every third word replaced; a space of fewer dimensions than items; several blocks."""
    rng = random.Random(16)
    items, words = passages(rng, 60)
    docs = []
    for d in range(240):
        part = [x if k % 3 != d % 3 else rng.choice(words) for k, x in enumerate(items[d % 60].split())] if d % 2 else []
        docs.append((d, " ".join([*rng.choices(words, k=rng.randint(20, 200)), *part, *rng.choices(words, k=30)])))
    ev = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, d % 60) for d in range(1, 240, 2)}
    for size, rank in ((256, 40), (25, 16)):
        monkeypatch.setattr(leakage, "BLOCK_ITEMS", size)
        got = {(r[0], r[1]) for r in leakage.leaks(df, ev, rank=rank).collect()}
        assert not got - want and len(got) >= 0.97 * len(want)


def test_lcs():
    rng = random.Random(10)
    for _ in range(50):
        a, b = [[rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = leakage.lcs_positions(np.array(a), np.array(b))
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def pairs_table(spark):
    rng = random.Random(11)
    nouns, verbs, ends = ["parser", "reader", "tagger", "corpus", "graph", "encoder"], ["improves", "filters", "replaces", "extends"], ["the shared vectors", "each table of the corpus", "all answers of the annotators", "the results of the baseline"]
    line = lambda: f"the {rng.choice(nouns)} {rng.choice(verbs)} {rng.choice(ends)} on the {rng.choice(nouns)}"
    foreign = ["Das Modell vergleicht die Antworten der Annotatoren mit dem alten Verfahren.", "Le modèle compare les réponses des annotateurs avec une liste fixe de questions.", "El modelo compara las respuestas de los anotadores con una lista fija."]
    refusals = ["I'm sorry, but I cannot help with this request.", "As an assistant, I won't answer this question.", "Unfortunately, I am not able to comment on this text."]
    rows, want = [], {}
    for i in range(900):
        long = i % 2 == 1
        q = ". ".join(line().capitalize() for _ in range(5)) + "." if long else f"What does the {rng.choice(nouns)} of {rng.choice(['KorNet', 'VelQA'])} do with {rng.choice(ends)}?"
        sound = "\n".join(rng.sample(["shared vectors", "old parser", "baseline results", "answers of annotators", "table reader"], 3)) if long else rng.choice([line(), line().capitalize() + ".", "yes", "KorNet ; VelQA", "17", f"On the question {q[0].lower() + q[1:-1]}, the answer is {line()}."])
        kind = rng.choice([None, None, None, None, None, "empty", "refusal", "copied", "other_language", "truncated"])
        answer = {None: sound, "empty": rng.choice([None, "", " \n", "N/A", "[]", "null", "​"]), "refusal": rng.choice(refusals), "copied": (q if not long else q.split(". ")[0] + ". " + q.split(". ")[1] + "."), "other_language": rng.choice(foreign), "truncated": sound + "\n" + " ".join(sound.split("\n")[:2]) + " (such as" if long else line().capitalize() + ". " + line().capitalize() + rng.choice([" and the", " because", " (see"])}[kind]
        rows.append(("t", str(i), q, answer, long, "clash"))
        if kind:
            want["t", str(i)] = kind
    return spark.createDataFrame(rows, "tbl string, row_key string, prompt string, response string, long_prompt boolean, name string"), want


def test_defects(spark):
    df, want = pairs_table(spark)
    got = {(r["tbl"], r["row_key"]): r["defect"] for r in defects.defects(df).collect()}
    assert len(got) <= len(want) * 1.05
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.95 * len(want)


def test_rare_last_words_are_looked_up(spark, monkeypatch):
    """With most words outside of the lexicon the verdicts on last words stay the same."""
    rng = random.Random(21)
    words = ["".join(rng.choices("bdfglmnprst", k=1)[0] + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    rows = []
    for i in range(900):
        w = rng.choices(words, k=8)
        q = f"What does the {w[0]} of the {w[1]} do with the {w[2]} and the {w[3]}?"
        a = f"the {w[4]} of the {w[5]} is in the {w[6]} for the {w[7][: rng.choice([5, 7, 10, 10, 10, 10])]}"
        rows.append(("t", str(i), q, a, False))
    df = spark.createDataFrame(rows, "tbl string, row_key string, prompt string, response string, long_prompt boolean")
    full = {tuple(r) for r in defects.defects(df).collect()}
    monkeypatch.setattr(defects, "MAX_WORDS", 20)
    lexicon, _ = defects.lexicon_of(df)
    assert not lexicon.whole and len(set(lexicon.count) & set(words)) < 30
    few = {tuple(r) for r in defects.defects(df).collect()}
    cut_off = {r[1] for r in rows if r[3].split()[-1] not in words}
    assert {k for _, k, d in full if d == "truncated"} >= cut_off and len(full ^ few) <= 0.02 * len(full)


def test_telling_words_beyond_the_lexicon(spark, monkeypatch):
    """Responses in another language are found by learned words that the lexicon has no room for."""
    rng = random.Random(22)
    make = lambda n, ends: ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4)) + e for e in ends for _ in range(n)]
    english, german = make(40, "k"), make(40, "z")
    rows, foreign = [], set()
    for i in range(1200):
        e, g = rng.choices(english, k=8), rng.choices(german, k=8)
        if i % 3 == 0:
            rows.append(("t", str(i), f"Was ist der {g[0]} und die {g[1]} mit dem {g[2]} und der {g[3]}?", f"der {g[4]} ist nicht die {g[5]} und der {g[6]}.", False))
        elif i % 20 == 1:
            foreign.add(str(i))
            rows.append(("t", str(i), f"What does the {e[0]} of the {e[1]} do with the {e[2]}?", " ".join(g[:5]) + ".", False))
        else:
            rows.append(("t", str(i), f"What does the {e[0]} of the {e[1]} do with the {e[2]} and the {e[3]}?", f"the {e[4]} of the {e[5]} is in the {e[6]}.", False))
    df = spark.createDataFrame(rows, "tbl string, row_key string, prompt string, response string, long_prompt boolean")
    full = {tuple(r) for r in defects.defects(df).collect()}
    monkeypatch.setattr(defects, "MAX_WORDS", 20)
    lexicon, _ = defects.lexicon_of(df)
    assert not lexicon.told and len(set(lexicon.language) & set(german)) < 20
    few = {tuple(r) for r in defects.defects(df).collect()}
    assert {("t", k, "other_language") for k in foreign} <= full and full == few


def test_defects_edges(spark):
    schema = "tbl string, row_key string, prompt string, response string, long_prompt boolean"
    assert defects.defects(spark.createDataFrame([], schema)).count() == 0
    rows = [("t", "1", None, "yes", False), ("t", "2", None, None, True), ("t", "2", None, None, True), ("t", "3", "Why?", "word " * 30_000, False), ("t", None, "", "", False)]
    got = sorted((r["row_key"] or "", r["defect"]) for r in defects.defects(spark.createDataFrame(rows, schema)).collect())
    assert [g for g in got if g[0] in ("", "2")] == [("", "empty"), ("2", "empty"), ("2", "empty")] and ("1", "empty") not in got


@pytest.mark.parametrize("text,want", [(None, True), ("", True), ("​ \n", True), ("N/A", True), ("(no answer given)", True), ("-", True), ("no", False), ("0", False), ("unanswerable", False), ("N/A labels", False), ("N/A" + " " * 70, True), ("\u200b" * 70 + "N/A" + "\u200b" * 70, True), ("n\u200b/a", True), ("(no answer given) " + "." * 90, True), ("-" * 500, True), ("no answer given by the authors of the parser", False)])
def test_empty(text, want):
    assert defects.is_empty(text) is want


def test_words_and_refusals_by_the_short_way():
    """The ways for ASCII text give what the patterns give."""
    rng = random.Random(13)
    cues = [*defects._ANY_BEGINS, "can't", "won't", "don't have access", "not able", "not possible", "rather not", "no access", "ask an expert", "language model", "anything else you need", "tut mir leid", "lo siento", "désolé", "can’t", "抱歉"]
    texts = ["".join(rng.choices("aB1-'’ .,;:!?\n\t\"()[]_…。中é\u200b", k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["".join(rng.choice(cues) + rng.choice([" ", "-", "_", "'", ". ", "\n"]) for _ in range(3)) for _ in range(5_000)]
    # every form of every alternative of the pattern
    texts += "cannot|can't|can not|could not|unable|won't|will not|not able|not possible|decline|declines|declined|declining|refuse|refuses|refused|rather not|prefer not|not comfortable|no access|not have access|don't have access|not allow|not allowed|not permit|not permitted|may not|darf|kann|nicht|ne peux|puedo|puede|sorry|apologies|apologize|apologise|unfortunately|regret|leider|tut mir leid|lo siento|guidelines|instructions|policy|policies|usage rules|rules|safety|settings|assistant|language model|request|violate|violates|allowed|anything else you need|ask an expert".split("|")
    for text in texts:
        assert defects.words_in(text) == defects._WORD.findall(text), text
        assert defects.refuses_nothing(text.lower()) == (not defects._ANY.search(text.lower())), text


def test_sound_text_costs_no_slow_pattern(monkeypatch):
    """A sound response in ASCII is judged without the patterns for all scripts and for refusals, and its prompt too."""
    lexicon, field = defects.Lexicon(), defects.train([], defects.Lexicon())
    prompt = "The rule-based ranker of the corpus is compared with each of the decoders, and the authors' graph is filtered before it is read."
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0
        def __getattr__(self, name):
            self.n += 1
            return getattr(self.pattern, name)
    counted = {name: Counted(getattr(defects, name)) for name in ("_WORD", "_ANY")}
    for name, made in counted.items():
        monkeypatch.setattr(defects, name, made)
    for text in ("- rule-based ranker\n- graph of the authors\n- decoders", "It is compared with the decoders, then filtered.", "yes"):
        for long_prompt in (True, False):
            defects.verdict(text, defects.Prompt(prompt, lexicon), lexicon, field, long_prompt)
    assert [made.n for made in counted.values()] == [0, 0]
    defects.verdict("I am sorry, I cannot answer 中 this request.", defects.Prompt(prompt, lexicon), lexicon, field, True)
    assert all(made.n for made in counted.values())


def test_field_learns_transitions():
    rng = random.Random(12)
    rows, tags = [], []
    for _ in range(200):
        n = rng.randint(1, 5)
        t = [rng.choice([0, 1])]
        while len(t) < n:
            t.append(t[-1])
        rows.append([[0, 10 + t[0]] if i == 0 else [0] for i in range(n)])
        tags.append(t)
    field = defects.Field().fit(rows, tags)
    assert all(field.tag(r) == t for r, t in zip(rows, tags))
