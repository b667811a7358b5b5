"""Pages that list the people of an organisation: a name and a role on one line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as x
from attestry.functions import urls as u

#: Parts of the path or title of a page that lists people, parts that rule a page out, and roles.
DIRECTORY = [
    "a propos", "about", "about us", "comite de direction", "direction", "direction generale", "dirigeants", "equipe", "equipe de direction", "equipe dirigeante", "executive team",
    "governance", "gouvernance", "leadership", "la direction", "management", "management team", "notre equipe", "nos dirigeants", "our team", "people", "team", "qui sommes nous", "who we are",
]
DIRECTORY_TITLES = [*DIRECTORY, "a propos de nous", "meet the team", "notre direction", "the team"]
DIRECTORY_NAMES = ["direction", "dirigeants", "equipe", "governance", "gouvernance", "leadership", "management", "people", "team"]
EXCLUDED = [
    "accueil", "actualites", "article", "articles", "blog", "conditions generales", "confidentialite", "contact", "contact us", "contactez nous", "contacts", "home", "homepage", "legal",
    "legal notice", "login", "menu", "mentions legales", "navigation", "news", "politique de confidentialite", "press", "presse", "privacy", "privacy policy", "recherche", "resources",
    "ressources", "search", "signin", "terms", "terms and conditions",
]
ROLES = (
    r"^(?:(?:ceo|cfo|chro|cio|cmo|coo|cpo|cro|cso|cto)|chief (?:executive|financial|human resources|information|marketing|operating|people|product|revenue|strategy|technology) officer"
    r"|(?:co[- ]?)?founder|(?:co[- ]?)?fondateur|(?:co[- ]?)?fondatrice|(?:chairman|chairperson|chairwoman|managing director|partner)"
    r"|(?:president|président|présidente|vice[- ]president|vice[- ]président|vice[- ]présidente)|(?:directeur|directrice)(?: général| générale)?|(?:gérant|gérante|associé|associée))$"
)


def directory_role(facts: DataFrame) -> DataFrame:
    """Q2: facts with directory_role: the excerpt is the selected person's name, a separator and a listed role, on a page that lists people.

    facts: category, entity_type, scope_type, scope_label, excerpt, url, title, display_name. Null columns give false.
    """
    plain = lambda c: F.regexp_replace(x.plain_key(x.visible_text(c)), "’", "'")
    part = lambda c: F.trim(F.regexp_replace(x.without_marks(F.lower(c)), r"[^\p{L}\p{N}]+", " "))
    count = lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))
    solid = lambda a: F.filter(a, lambda p: p != "")
    paths = solid(F.transform(F.split(u.path(F.col("url")), "/"), lambda p: F.coalesce(part(F.try_url_decode(p)), F.lit(""))))
    titles = solid(F.transform(F.split("title", r"\s*(?:[|•·:–—]|\s+-\s+)\s*"), part))
    among = lambda a, names: F.arrays_overlap(a, F.array(*map(F.lit, names)))
    d = facts.withColumns({"__n": plain(F.col("display_name")), "__s": part(F.col("display_name")), "__paths": paths, "__titles": titles, "__t": plain(F.col("title")), "__e": plain(F.col("excerpt"))})
    page = (
        (F.size("__paths") <= 6) & ~among(F.col("__paths"), EXCLUDED) & F.length("__t").between(1, 180) & (count(F.col("__t")) <= 18) & ~among(F.col("__titles"), EXCLUDED)
        & (among(F.col("__paths"), DIRECTORY) | among(F.col("__titles"), DIRECTORY_TITLES))
    )
    subject = (
        (F.col("category") == "role") & (F.col("entity_type") == "person") & (F.col("scope_type") == "person") & (plain(F.col("scope_label")) == F.col("__n")) & F.col("scope_label").isNotNull()
        & count(F.col("__n")).between(2, 5) & ~F.col("__s").isin(*DIRECTORY_TITLES) & ~among(F.split("__s", " "), DIRECTORY_NAMES)
    )
    rest = F.substring(F.col("__e"), F.length("__n") + 1, F.lit(1 << 30))
    role = F.trim(F.regexp_replace(rest, r"^\s*(?:[/|•·,:–—-]\s*)?", ""))
    listed = F.col("__e").startswith(F.col("__n")) & rest.rlike(r"^[\s/|•·,:–—-]") & F.length(role).between(1, 64) & (count(role) <= 6) & role.rlike(ROLES)
    return d.withColumn("directory_role", F.coalesce(page & subject & listed, F.lit(False))).select(*facts.columns, "directory_role")
