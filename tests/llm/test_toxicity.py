from annospark.llm import toxicity
from annospark.llm.common import read


def test_clauses_not_words():
    scorer = toxicity.Scorer(toxicity.Lexicon({"grump": 4.0}, {"snork": 5.0}))
    evidence = scorer.clause
    assert evidence("a calm day") == 0
    assert evidence("he is a grump") > evidence("a grump came") > evidence("he said a grump came") > evidence("not a grump") > 0
    assert evidence("not today and then the grump") == evidence("a grump came")
    assert evidence("snorkling") == 0.88 * 5.0 and evidence("you snorkling") == 1.2 * 5.0 and evidence("snor") == 0
    assert evidence("i will kill you") < evidence("you i will kill")
    assert evidence("i kill time") < 0.5
    assert scorer.text("You are a grump. Fine day.")[1] == 1
    low, high = scorer.text("a grump")[0], scorer.text("a grump; a grump")[0]
    assert 0 <= scorer.text(None)[0] == scorer.text("")[0] < low < high <= 1


def test_lone_insults_and_threats_at_no_one_do_not_decide():
    score = lambda text: toxicity.Scorer(toxicity.Lexicon({}, {})).text(text)[0]
    for calm in ("stupid", "the stupid door is stuck again", "i kill time", "you are not stupid", "i will not kill you", "he said kill"):
        assert score(calm) < 0.7, calm
    for harm in ("i will kill you", "you stupid door", "stupid worthless scum", "you i will hurt", "du bist dumm", "je vais te tuer"):
        assert score(harm) >= 0.7, harm
    assert score("i will kill you") > score("he said i will kill you")


def test_symbols_are_rewritten():
    def written(*symbols):
        state, out = toxicity.GRAMMAR.start, []
        for symbol in symbols:
            state, last, _ = toxicity.GRAMMAR.move(state, symbol)
            out.append(last)
        return out

    t = toxicity
    assert written(t.TARGET, t.INSULT, t.INSULT) == [t.TARGET, t.AIMED_INSULT, t.AIMED_INSULT]
    assert written(t.INSULT, t.INSULT) == [t.INSULT, t.AIMED_INSULT]
    assert written(t.THREAT, t.OTHER, t.TARGET, t.THREAT) == [t.THREAT, t.OTHER, t.LATE_THREAT, t.AIMED_THREAT]
    assert written(t.DENIAL, t.THREAT, t.TARGET) == [t.DENIAL, t.DENIED_THREAT, t.TARGET]
    assert written(t.REPORT, t.TARGET, t.THREAT, t.INSULT) == [t.REPORT, t.TARGET, t.QUOTED_THREAT, t.QUOTED]
    assert written(t.DENIAL, t.OTHER, t.OTHER, t.OTHER, t.INSULT)[-1] == t.INSULT


def test_composition_reads_what_was_written():
    swap = toxicity.Transducer(0, lambda s, x: (s + 1, toxicity.DENIAL if x == toxicity.OTHER else x, 2.0))
    both = swap.then(toxicity.Transducer(0, toxicity._negation))
    state, _, weight = both.move(both.start, toxicity.OTHER)
    assert weight == 2.0
    assert both.move(state, toxicity.INSULT)[1:] == (toxicity.DENIED, 2.0)


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "You snorker", 1.0), (1, "You snorker", 1.0), (2, None, 1.0), (None, "", 1.0), (5, "idiot " * 60_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    got = toxicity.score(docs, lexicon)
    assert got.columns == ["doc_id", "score", "matched_clauses"] and got.count() == 5
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(docs.filter("false"), toxicity.train(docs.filter("false"), labels.filter("false"))).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    got = [r for r in toxicity.op1_toxicity(spark, sf).collect()]
    assert len(got) == read(spark, sf, "documents").count()
    held = [r for r in got if r.held_out and r.doc_id in label]
    hit = sum(r.predicted and label[r.doc_id] for r in held)
    assert hit / sum(r.predicted for r in held) > 0.95
    assert hit / sum(label[r.doc_id] for r in held) > 0.9
