"""Our own sample lines that turn the given tables into triage input.

The given documents hold no French trigger words, bank numbers or replies, so every row
gets one of these lines, chosen by its id.
"""

# One hit and one near miss per input rule, personal data in several spellings, neutral lines.
SNIPPETS = (
    "Je souhaite changer mon RIB avant la fin du mois.",
    "Pouvez-vous m'envoyer un RIB de votre agence ?",
    "Merci de MODIFIER dès que possible mes COORDONNÉES BANCAIRES.",
    "Voici la procuration signée par ma mère.",
    "Le mandataires de la ville vous salue.",
    "Je suis au CHÔMAGE et j'ai un IMPAYÉ depuis mars.",
    "Est-il possible d'étaler mes paiements ? difficulté passagère à régler la cotisation.",
    "Le délai de livraison est trop long.",
    "Suite au DÉCÈS de mon père, je vous écris.",
    "Mon voisin est veuf depuis peu.",
    "Je pense être victime d'une fraude.",
    "Des opérations non autorisées figurent sur mon relevé.",
    "Le bateau du pirat est au port.",
    "Mon avocat vous contactera demain.",
    "Ceci vaut mise en demeure.",
    "Le juge de paix est en vacances.",
    "Je conteste ce montant.",
    "La facture a été prélevée deux fois ce mois-ci.",
    "La cotisation est double cette année.",
    "Je suis journalistes au quotidien local et cherche un contact.",
    "Demande d'interview pour notre rédaction.",
    "Ceci est un message automatique.",
    "Merci de ne pas répondre à cet e-mail.",
    "Voir pièce jointe.",
    "Mon IBAN est FR76 3000 4000 0500 0012 3456 789 pour le virement.",
    "Compte : FR7630004000050000123456789.",
    "Numéro de sécurité sociale 1 85 05 78 006 084 36.",
    "Mon numéro 2850578006084 figure au dossier.",
    "Payé avec la carte 4111 1111 1111 1111 hier.",
    "La carte 4111-1111-1111-1112 ne passe pas.",
    "Appelez-moi au 06 12 34 56 78 ce soir.",
    "Mon fixe : +33 1.42.68.53.00, bureau 0033 612345678.",
    "Joignez-moi sur 06-12-34-56-78 ou a.martin@exemple.fr.",
    "Écrivez à service.client@exemple.com, merci.",
    "Cordialement, Marie Dupont",
    "Signé Paul MARTIN, puis encore martin.",
    "Pourriez-vous m'envoyer une attestation ?",
    "Bonjour, je voudrais connaître vos horaires.",
    "Merci beaucoup pour votre aide rapide.",
    "J'ai bien reçu le document, bonne journée.",
)

# Senders: display name, dotted address, address with digits, role mailbox, automatic, none.
DISPLAY_NAMES = (
    "Marie Dupont", "Paul Martin", "Lea Bernard", "Hugo Petit",
    "Nina Leroy", "Jules Moreau", "Emma Girard", "Adam Roux",
)
SUBJECTS = (
    "Demande de renseignement",
    "Question sur mon contrat",
    "Suivi de dossier pour contact@exemple.fr",
    "Nouvelle adresse",
    "Urgent : réponse attendue",
)
CATEGORY_CYCLE = (
    "reclamation", "resiliation", "donnees_personnelles", "demande", "information",
    "facturation", "support_technique", "spam", "autre",
)
PRIORITY_CYCLE = ("normale", "basse", "haute")

# Eight clean replies and one per output rule.
REPLIES = (
    "Bonjour [CLIENT_NAME], nous avons bien reçu votre message et revenons vers vous.",
    "Bonjour, votre attestation est disponible dans votre espace client.",
    "Bonjour [CLIENT_NAME], notre service étudie votre demande sous cinq jours.",
    "Bonjour, un conseiller prendra contact avec vous.",
    "Bonjour, nous vous remercions de votre patience.",
    "Bonjour, votre dossier est complet.",
    "Bonjour, voici nos horaires : du lundi au vendredi.",
    "Bonjour, joignez-nous au 01 42 68 53 00 ou à service@exemple.fr.",
    "Bonjour, utilisez le code promo BIENVENUE pour votre cotisation.",
    "Bonjour, suivez ce lien : https://exemple.fr/espace",
    "Bonjour, en tant qu'assistant je ne peux pas répondre.",
    "Bonjour, votre remboursement a été validé ce matin.",
)
CASE_REASONS = (
    "rules_table:reclamation",
    "priorite:haute",
    "sensitive:fraude_suspectee+menace_juridique",
    "output_guardrail:lien_externe",
    "degenerate_input",
    "judge_reject",
    "seuils",
)
EDIT_TEXTS = REPLIES
