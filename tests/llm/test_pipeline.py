"""The pipeline against a plain version of every stage, on the small tables."""

import hashlib
import re

import duckdb
import pytest
import sentencepiece
from corpora import FOLDER
from test_line_dedup import brute as repeated_lines
from test_simhash import brute as groups

import corpus_pipeline
from tidewatch.llm.oracles import oracle_sql
from tidewatch.llm.queries import queries, tokenizer_path


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def expected_rows():
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    rated = duck.execute(oracle_sql()["op6_quality_rules"]).fetchdf()
    kept = set(rated[rated.kept].doc_id)
    docs = [(d, t) for d, t in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if d in kept]
    gone = repeated_lines(docs)
    docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in docs]
    docs = [(d, t) for d, t in docs if (d, d) in {(r[0], r[2]) for r in groups(docs)}]
    grams = {tuple(w[k: k + 13]) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall() for w in [words(t)] for k in range(len(w) - 12)}
    docs = [(d, t) for d, t in docs for w in [words(t)] if not any(tuple(w[k: k + 13]) in grams for k in range(len(w) - 12))]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = []
    for d, t in docs:
        ids = [*library.encode(t), 2]
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_is_its_stages_done_plainly(spark):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == expected_rows()


def test_stages_keep_the_columns_of_documents(spark, odd, tmp_path):
    for table in (odd, odd.where("false")):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == table.columns, name
            docs.write.parquet(f"{tmp_path}/{table.count()}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{table.count()}-{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


@pytest.mark.parametrize("number", range(1, 11))
def test_each_operator_has_one_query(number):
    assert sum(name.startswith(f"op{number}_") for name in queries()) == 1
