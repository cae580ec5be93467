"""Raw model answers in many shapes, one per event, for the parsers."""

# __C__ category, __N__ two digits, __A__ to __D__ scores 1 to 5
CLASSIFIER = (
    '{"categorie": "__C__", "priorite": "basse", "resume": "ok", "confiance": 0.__N__}',
    '{"categorie": "__C__", "priorite": "normale", "resume": "texte", "confiance": "0.__N__"}',
    '{"confiance": 0.8}',
    "désolé, je ne peux pas répondre",
    '["__C__"]',
    '{"categorie": "__C__", "priorite": "haute", "resume": "", "confiance": null}',
    '{"categorie": "__C__", "priorite": "haute", "resume": "", "confiance": "haute"}',
    '{"categorie": "facture", "priorite": "basse", "resume": "x", "confiance": 0.5}',
    '{"categorie": "__C__", "priorite": "basse", "resume": "x", "confiance": 1.5}',
    '{"categorie": "__C__", "priorite": "faible", "resume": "x", "expediteur": null, "confiance": 1}',
    '{"categorie": "__C__", "priorite": "basse", "resume": 5, "confiance": 0.__N__}',
    "",
    '{"categorie": "__C__", "priorite": "basse", "resume": "x", "expediteur": "Marie", "action_suggeree": "répondre", "confiance": true}',
)
_SCORES = '"pertinence": __A__, "ton": __B__, "conformite": __C__, "factualite": __D__'
JUDGE = (
    "{" + _SCORES + ', "verdict": "AUTO_SEND", "feedback": "bien", "issues": []}',
    '{"pertinence": "4", "ton": 5, "conformite": 4, "factualite": 4, "verdict": "AUTO_SEND"}',
    '{"pertinence": 4.0, "ton": 5, "conformite": 4, "factualite": __D__, "verdict": "HUMAN_REVIEW", "issues": ["ton"]}',
    '{"pertinence": 4.6, "ton": 5, "conformite": 4, "factualite": 4, "verdict": "AUTO_SEND"}',
    '{"pertinence": 6, "ton": 5, "conformite": 4, "factualite": 4, "verdict": "AUTO_SEND"}',
    "{" + _SCORES + ', "verdict": "SEND"}',
    '{"pertinence": __A__, "ton": 5, "verdict": "AUTO_SEND"}',
    "{" + _SCORES + ', "verdict": "REJECT", "feedback": "non", "surplus": 1}',
    "pas de JSON",
    "[4, 4, 4, 4]",
    "",
    "{" + _SCORES + ', "verdict": "AUTO_SEND", "feedback": null}',
    "{" + _SCORES + ', "verdict": "AUTO_SEND", "issues": [1]}',
)
