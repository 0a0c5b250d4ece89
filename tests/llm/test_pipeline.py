"""Each stage of the pipeline against a plain version, with awkward rows."""

import random
import re

import pytest

from tests.llm import fixtures
from tests.llm.test_models import labelled
from tests.llm.test_similarity import classes, edited, shingles
from tidewatch.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "bucket"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int")


def awkward(spark):
    return table(spark, [*enumerate(fixtures.texts()), (None, "null key"), (None, "null key"), (None, None), (4, "tie b"), (4, "tie a"), (4, "tie a")])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled(900, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, fixtures.prose(random.Random(50), 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    table(spark, [(i, t) for i, t, _ in labelled(900, 1)]).write.parquet(f"{path}/documents.parquet")
    return path


def test_toxic_documents_go(spark, sf_dir):
    rows = labelled(900, 1)
    kept = pipeline.drop_toxic(spark, table(spark, [(i, t) for i, t, _ in rows]), sf_dir)
    assert kept.columns == COLUMNS
    left = {r.doc_id for r in kept.collect()}
    bad, calm = ({i for i, _, y in rows if y == k} for k in (1, 0))
    assert len(bad & left) < 0.1 * len(bad) and len(calm & left) > 0.97 * len(calm)


def test_one_of_each_group_stays(spark, sf_dir):
    rng = random.Random(3)
    rows = [(i, fixtures.prose(rng, rng.choice([8, 60, 200]))) for i in range(30)]
    rows += [(100 + i, " ".join(edited(rng, rows[i % 30][1].split(), rng.choice([0, 0.01, 0.03])))) for i in range(60)]
    kept = pipeline.drop_near_copies(spark, table(spark, rows), sf_dir)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(rows, 5, 80).values()))
    out = pipeline.drop_near_copies(spark, awkward(spark), sf_dir).collect()
    assert sum(r.doc_id is None for r in out) == 3 and sorted(r.text for r in out if r.doc_id == 4 and r.text.startswith("tie")) == ["tie a", "tie b"]
    assert sum(r.text is None for r in out) == 3 and not {40, 41} & {r.doc_id for r in out}  # nulls stay, copies of 3 go


def test_later_passages_are_cut(spark, sf_dir):
    rng = random.Random(4)
    passage = fixtures.prose(rng, 80)
    rows = [(i, f"{fixtures.prose(rng, 30)} a{i} {passage} b{i} {fixtures.prose(rng, 30)}") for i in range(5)] + [(9, passage), (10, None), (11, ""), (None, passage)]
    kept = {r.doc_id: r for r in pipeline.cut_repeats(spark, table(spark, rows), sf_dir).collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 10, 11, None} and list(kept[0].asDict()) == COLUMNS
    assert kept[0].text == rows[0][1] and kept[None].text == passage and kept[10].text is None and kept[11].text == ""
    for i in range(1, 5):
        assert kept[i].text == rows[i][1].replace(passage, "") and kept[i].n_chars == len(kept[i].text)
    assert pipeline.cut_repeats(spark, awkward(spark), sf_dir).columns == COLUMNS


def test_contaminated_documents_go(spark, sf_dir):
    rng = random.Random(5)
    item = fixtures.prose(random.Random(50), 20)
    rows = [(i, fixtures.prose(rng, 50) + (" " + item if i % 4 == 0 else "") + " end") for i in range(20)] + [(30, item), (31, " ".join(item.split()[:15])), (None, item), (32, None)]
    kept = pipeline.drop_contaminated(spark, table(spark, rows), sf_dir)
    want = {i for i, t in rows if i is None or 100 * len(shingles(t, 5) & shingles(item, 5)) < 80 * len(shingles(item, 5))}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want and 31 in want and 30 not in want
    df = awkward(spark)
    assert pipeline.drop_contaminated(spark, df, sf_dir).count() == df.count()


def test_tokens_are_those_of_tiktoken(spark, sf_dir):
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path(pipeline.RANKS)), special_tokens={})
    df = awkward(spark)
    got = pipeline.tokenize(spark, df, sf_dir).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(r.doc_id), encoder.encode_ordinary(r.text or "")) for r in df.collect())
    assert all(r.n_tokens == len(r.ids) and r.lang == "en" for r in got)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    assert [re.sub("_.*", "", n) for n, _ in pipeline.STAGES] == ["toxicity", "near", "repeated", "decontamination", "byte"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).count() == 0
    got = pipeline.run(spark, sf_dir).collect()
    assert 400 < len(got) < 650 and all(r.n_tokens == len(r.ids) for r in got)
