import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexmill.llm import residue

TABLES = "/root/testdata/sf0.01/captures.parquet"

# Standard phrases: status lines of the HTTP standard, the usual demands for scripts and the usual labels of pages. They stand on real
# pages everywhere, so they stand in the tables and in the lists.
STANDARD = {
    "error 0", "error code 0", "error code: 0", "0 not found", "0 service unavailable", "0 – page not found", "this content is no longer available.", "access denied", "bad gateway",
    "please try again in a few minutes.", "please try again later.", "traceback (most recent call last):", "just a moment...", "please enable javascript to view this page.",
    "you need to enable javascript to run this app.", "seite nicht gefunden", "page introuvable", "página no encontrada", "страница не найдена", "page not found", "internal server error",
    "your headline goes here", "untitled document", "asdf asdf asdf", "to be confirmed",
}


def fold(line):
    return re.sub(r"\d+", "0", " ".join(line.lower().split()))


@pytest.mark.skipif(not os.path.exists(TABLES), reason="needs the test tables")
def test_seeds_are_not_taken_from_the_tables():
    table = pq.read_table(TABLES, columns=["text", "title"])
    lines = {fold(x) for c in table.columns for v in c.to_pylist() if v for line in v.split("\n") for x in [line, *re.split(r"(?<=[.!?…])\s+", line)]}
    seeds = {fold(x) for x in residue.FILLER + residue.NOTICES + residue.DISCUSSED if " " in x.strip()}
    assert seeds & lines <= STANDARD


# Wordings that no list holds.
HELD_OUT = [
    "This domain is parked. The page you wanted does not exist.",
    "Whoops, the server could not complete your request. Please try again later.",
    "Our servers are under maintenance, please come back later.",
    "Scripts are disabled in your browser, please enable them to read this page.",
    "Access to this resource is forbidden. Reference number 99812",
    "Ut enim ad minim lorem dolor, consectetur magna aliqua.",
    "Please replace this dummy text with your own text.",
    "Die angeforderte Adresse wurde auf diesem Server nicht gefunden.",
    "La page que vous avez demandée n’existe plus sur ce site.",
    "La página que usted solicitó no existe en este servidor.",
    "Запрошенная вами страница не найдена на сервере.",
]
ORDINARY = [
    "The desk moved 12 cases to the new office in March and the queue fell by half before the summer.",
    "Der Betrieb zählte im Herbst 40 Anfragen mehr als im Jahr davor und stellte zwei Leute ein.",
    "Le service a traité plus de dossiers en avril et le délai moyen est tombé à six jours.",
    "El equipo revisó los contratos de la ciudad y publicó un informe sobre los costes.",
    "Служба закупок сократила сроки поставки и наняла двух новых сотрудников в Казани.",
    "An access denied message had puzzled the clerks for weeks, as the report says.",
    "Se connecter", "Was this page helpful?", "Sign in | Contact sales | About us",
]


@pytest.mark.parametrize("text", HELD_OUT)
def test_held_out_notices_and_filler(text):
    assert residue.windows([text], residue.fit(ORDINARY))


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_text(text):
    assert residue.windows([text], residue.fit(ORDINARY)) == []


def test_counts_cover_every_text(spark):
    texts = ["", None, "short", "x" * 50_000 + "tail", "Größe 12\nGröße 34", "UPPER"] * 7
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, gram int")
    want = sum(np.bincount(residue._hashes(residue._runs([t])), minlength=1 << residue.BITS) for t in texts if t)
    got = residue.count_ngrams(df.repartition(3), "text")
    assert (got == want).all() and (residue.count_ngrams(df.coalesce(1), "text") == want).all()
    assert residue.count_ngrams(df.where("false"), "text").sum() == 0
