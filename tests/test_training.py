from pyspark.sql import functions as F

from shopstream.operators import model as mdl
from shopstream.operators import sessions as sess
from shopstream.operators import vocab as voc
from shopstream.plans import training
from shopstream.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_train_and_refresh(spark):
    clicks = fx.clicks(spark, SF)
    res = training.train(clicks, vocab_size=60, grid=training.DEFAULT_GRID[:2])
    assert res.params in training.DEFAULT_GRID[:2]
    assert 0.0 <= res.test["recall"] <= 1.0 and 0.0 <= res.popularity_recall <= 1.0
    assert len(res.history) >= 1
    # warm start with alpha=1 and a frozen vocab/cap equals a refit on both windows
    cut = F.to_timestamp_ntz(F.lit("2024-01-20"))
    stats = sess.session_stats(clicks)
    first = clicks.join(stats.filter(F.col("start_time") < cut).select("user_session"), "user_session", "left_semi")
    second = clicks.join(stats.filter(F.col("start_time") >= cut).select("user_session"), "user_session", "left_semi")
    cap = sess.cap_value(stats)
    vocab = res.vocab
    p = res.params

    def fit(ev):
        e = voc.encode(sess.build_sessions(ev, cap=cap, percentile=None), vocab)
        return mdl.fit_transitions(e, max_lag=p["max_lag"], decay=p["decay"]), mdl.fit_prior(e)

    t1, p1 = fit(first)
    old = training.TrainResult(p, 0.0, {}, 0.0, [], t1, p1, vocab)
    new = training.refresh(old, second, cap=cap)
    full_t, full_p = fit(clicks)
    as_set = lambda df: sorted(map(tuple, df.select("src", "dst", "weight", "n").collect()))
    assert as_set(new.transitions) == as_set(full_t)
    assert sorted(map(tuple, new.prior.collect())) == sorted(map(tuple, full_p.select("dst", "prior_n").collect()))


def test_vocab_save_load_and_accent_search(spark, tmp_dir):
    from shopstream.operators import storefront as sf
    s = sess.build_sessions(fx.clicks(spark, SF))
    v = voc.build_vocab(s, size=20)
    voc.save_vocab(v, tmp_dir + "/vocab", json_path=tmp_dir + "/vocab_json")
    back = voc.load_vocab(spark, tmp_dir + "/vocab")
    assert sorted(back.collect()) == sorted(v.collect())
    assert voc.vocab_metadata(back).first().vocab_size == 20
    p = spark.createDataFrame([(1, "Crème Brûlée Set", "Élan"), (2, "Plain", None)],
                              "product_id long, display_name string, brand string")
    assert sf.filter_products(p, search="creme brulee", accent_insensitive=True).count() == 1
    assert sf.filter_products(p, search="ELAN", accent_insensitive=True).count() == 1
