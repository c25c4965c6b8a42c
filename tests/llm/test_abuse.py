import numpy as np
import pytest

from quarrylens.llm import abuse
from quarrylens.llm import lexicon as terms


@pytest.fixture(scope="module")
def lexicon():
    return abuse.Lexicon(abuse.ordinary_near())


@pytest.mark.parametrize("text", [
    "You are a worthless moron.", "Y0u 4r3 4 w0rthl355 m0r0n", "Y.o.u are a worthless m.o.r.o.n", "Yoooou aaare a worthleeess moroooon", "You are a worthles mroon",
    "Y​ou are a mo​ron", "Yоu аrе а mоrоn", "You are a m***n", "> he wrote: crawl back into your hole", "x = f(1)  # shut up you clown",
    "Women ruin everything they touch!", "Send me your nude pics tonight", "너 같은 쓰레기는 꺼져라", "Verpiss dich, du Vollidiot", "Vete al infierno, basura",
])
def test_found(lexicon, text):
    assert abuse.document_score(f"The fix is merged.\n{text}\nThanks.", lexicon) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "The parent must kill every orphan child before the worker dies.", "The word filter flags `idiot` and `moron` in test comments.",
    'The words "idiot" and "moron" are on the blocklist.', "You can add idiot to the filter list.",
    "I feel like an idiot, I forgot to bump the version.", "This damn parser is crap, but the fix is simple.", "A naked pointer is stripped from the dirty page.",
    "You people did great work on the release.", "Nobody wants to touch api/x.py, but I will try.", "Please send me your logs when you are back.",
    "Penetration tests abort when the slave node cannot find its master.", "이 바보 같은 오타 때문에 빌드가 죽었다.", "The sex column accepts three values and a null.",
    "We hate flaky tests as much as you do.", "Go away for lunch, the import job takes 40 minutes anyway.", "Your garbage collector pauses too long.",
    "The batch waits in the queue slot.", "필터는 병신 같은 단어를 막는다.", "이번 점검에서는 규칙을 다시 확인했다.", None, "", "!!! ***",
])
def test_not_found(lexicon, text):
    assert abuse.document_score(text, lexicon) < abuse.THRESHOLD


# Wording that stands in no table and in no term list as a whole.
UNSEEN = [
    "You are a complete waste of space.", "Go hang yourself.", "I will hunt you down.", "Women should never be engineers.", "I want to see you naked tonight.",
    "Du bist so ein Versager.", "What kind of moron are you?", "People like you are a plague.", "I hope you die alone.", "Foreigners are ruining it, deport them all.",
    "Somebody should break your fingers.", "You pathetic little creep.", "Muslims are savages.", "Nobody likes you, quit already.", "Show me your tits.",
    "Refugees are cockroaches.", "Eres tonta y una inútil.", "Halt endlich dein Maul, du Depp.", "I know where your family lives and I will hurt you.",
    "Gays are disgusting.", "Fuck off and drop dead.", "너는 정말 병신이다", "Your brain is full of shit.", "Send nudes or I will kill you.",
]
HARMLESS = [
    "Kill the old process before you start the new one.", "You should drop the table first.", "My head hurts from reading your patch.", "The clown fish dataset is too large.",
    "I hate this bug.", "Your mother tongue setting is wrong.", "They moved back home after the outage.", "Women and men were paid alike in the survey.",
    "The nude color palette needs a new name.", "Break the loop when you find the key.", "You will hit the limit soon.", "He quit the job and left the team.",
    "The adult dataset has 48842 rows.", "Hot path: two clips per frame.", "Please get rid of the dead code.", "You look tired, get some sleep.",
]


def test_unseen_wording(lexicon):
    found = [t for t in UNSEEN if abuse.document_score(t, lexicon) >= abuse.THRESHOLD]
    false = [t for t in HARMLESS if abuse.document_score(t, lexicon) >= abuse.THRESHOLD]
    assert len(found) >= 0.9 * len(UNSEEN) and len(false) <= 1, (set(UNSEEN) - set(found), false)


def test_automaton_against_brute_force():
    entries = ("moron", "clown", "idiot")

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for most in (0, 1, 2):
        automaton = abuse.Automaton({e: frozenset() for e in entries}, most)
        for w in ("moron", "mroon", "morn", "clowns", "idoit", "idol", "crown", "brown", "mornon", "x", "", "omron", "diiot"):
            assert automaton.near(w) == {e: distance(w, e) for e in entries if distance(w, e) <= most}, (w, most)


def test_remembered_words_change_nothing(lexicon):
    text = "You are a mroon and a tosser of coins."
    before = abuse.document_scores(text, lexicon)
    lexicon.kept.clear()
    assert abuse.document_scores(text, lexicon) == before


def test_quotation_is_told_apart(lexicon):
    direct, quoted = abuse.document_scores('He wrote "you are a stupid moron" in the thread.', lexicon)
    assert quoted >= abuse.THRESHOLD > direct
    direct, quoted = abuse.document_scores("You are a stupid moron.", lexicon)
    assert direct >= abuse.THRESHOLD > quoted


def test_weights_follow_labels():
    prior = np.array(list(terms.PRIOR.values()))
    k = list(terms.PRIOR).index("HARM_WEAK ADDRESS")
    up = abuse.fit_weights([([[k]], True)] * 200, prior)
    down = abuse.fit_weights([([[k]], False)] * 200, prior)
    assert up[k] > prior[k] > down[k] and np.array_equal(abuse.fit_weights([], prior), prior)


def test_table(spark):
    rows = [(1, "Forum ", "You are a moron", 0.0), (2, "forum", "fine", 0.0), (3, None, None, 0.0), (4, "forum", "You are a moron", 0.0), (5, "forum", "word " * 100000, 0.0)]
    rows += [(100 + i, "chat", "the batch waits in the queue slot for a worker", 0.0) for i in range(50)]
    rows += [(200 + i, "chat", "You are a mroon, go away.", 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, score double")
    labels = spark.createDataFrame([(1, "abuse", "a"), (2, "none", "b"), (2, None, "c"), (3, "none", "d"), (999, "hate", "e")], "doc_id long, category string, text string")
    scored = abuse.score_documents(df, labels)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[1] == got[4] >= abuse.THRESHOLD and got[3] == 0 and got[2] == 0 and max(got[100 + i] for i in range(50)) == 0
    assert min(got[200 + i] for i in range(30)) >= abuse.THRESHOLD
    rates = {r.source: r for r in abuse.source_rates(scored).collect()}
    assert rates["forum"].documents == 4 and rates["forum"].flagged == 2 and rates[None].flagged == 0
    assert abuse.score_documents(df.where("false"), labels.where("false")).count() == 0
