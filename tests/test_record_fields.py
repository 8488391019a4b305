"""Types and contents of all fields of a record, on lines as they come."""

import json

from quaestor.fixed_values import RECORD_FIELDS
from quaestor.operators.quality import typed_fields

GOOD = {
    "id": "PRB-1-7", "moncode": "7", "base": 1, "assemblee": "", "legislature": "2024-2029", "session": None, "type": "1", "numero": None, "langue": "fr",
    "titre": "T", "titre_nl": "", "auteur": "A", "destinataire": "B", "date_reception": "2024-02-29", "date_publication": None, "date_reponse": None,
    "question": "q", "reponse": None, "url_source": "https://records.example.org/a?b=1",
}

CHANGES = [
    ({"id": ""}, ["id"]),
    ({"moncode": "7a"}, ["moncode"]),
    ({"moncode": "7\n"}, ["moncode"]),
    ({"moncode": 7}, ["moncode"]),
    ({"base": 1.0, "numero": -3}, []),
    ({"base": 1.5, "numero": "3"}, ["base", "numero"]),
    ({"base": None, "numero": 2**53}, ["base", "numero"]),
    ({"session": 3, "langue": "nl"}, ["session", "langue"]),
    ({"titre": "", "titre_nl": None}, ["titre", "titre_nl"]),
    ({"date_reception": "2023-02-29", "date_publication": "2024-1-1", "date_reponse": "2024-01-01T00:00:00"}, ["date_reception", "date_publication", "date_reponse"]),
    ({"date_reception": None}, ["date_reception"]),
    ({"question": "", "reponse": ""}, ["question"]),
    ({"url_source": "records.example.org"}, ["url_source"]),
    ({"url_source": "https://"}, ["url_source"]),
    ({"url_source": "mailto:a@example.org"}, []),
    ({"extra": {"id": ""}}, []),
]


def test_fields(spark):
    names = [name for name, _ in RECORD_FIELDS]
    assert len(names) == 19 and set(names) == set(GOOD)
    cases = [(GOOD, [])] + [({**GOOD, **change}, broken) for change, broken in CHANGES]
    cases += [({k: v for k, v in GOOD.items() if k != name}, [] if name == "titre_nl" else [name]) for name in names]
    lines = [(json.dumps(record), broken) for record, broken in cases]
    every = [name for name in names if name != "titre_nl"]
    lines += [(None, every), ("", every), ("{", every), ("[]", every), ("7", every)]
    found = typed_fields(spark.createDataFrame(lines, "line string, broken array<string>")).collect()
    assert [(r.line, r.violations) for r in found] == lines
