import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
