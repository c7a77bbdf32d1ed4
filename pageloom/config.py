"""Fixed values and parameter objects of the index.

Everything a deployment may want to change is a field of one of the frozen
dataclasses at the bottom; the tuples above them are only their defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# --------------------------------------------------------------------------
# They decide which text is kept, so results depend on them.
# Patterns are written in the Python `re` dialect; functions/strings.py turns
# them into the dialect of Spark's regular expressions.
# --------------------------------------------------------------------------

# Remains of style sheets, matched without regard to case, removed in order.
# The second entry of a row lists lower-case strings of which at least one
# stands in every text the pattern can match (used to skip the pattern).
CSS_RULES = (
    (
        r"\b(font-family|font-size|font-weight|line-height|color|background|padding|margin):\s*[^;]+;?",
        (
            "font-family:",
            "font-size:",
            "font-weight:",
            "line-height:",
            "color:",
            "background:",
            "padding:",
            "margin:",
        ),
    ),
    (
        r"\b(Roboto|Arial|Helvetica|Noto|Sans|Serif|Courier)\b",
        ("roboto", "arial", "helvetica", "noto", "sans", "serif", "courier"),
    ),
    (r"rgba?\([^)]+\)", ("rgb",)),
    (r"#[0-9a-fA-F]{3,6}\b", ("#",)),
    (r"\d+px\b", ("px",)),
    (r"\d+em\b", ("em",)),
    (r"\d+%\b", ("%",)),
)

# Page furniture, matched without regard to case, removed in order.
NOISE_PATTERNS = (
    r"Was this page helpful\?",
    r"Was this helpful\?",
    r"Is this page helpful\?",
    r"Rate this page",
    r"Feedback",
    r"Edit this page",
    r"Edit on GitHub",
    r"Share on Twitter",
    r"Share on Facebook",
    r"Copy link",
    r"Table of contents",
    r"On this page",
    r"In this article",
    r"Skip to .*",
    r"Jump to .*",
    r"Back to top",
    r"Next chapter",
    r"Previous chapter",
    r"Print this page",
    r"Download PDF",
    r"={3,}",
    r"-{3,}",
    r"Contributors?:.*",
    r"Authors?:.*",
    r"Written by.*",
    r"Edited by.*",
    r"Reviewed by.*",
    r"Maintainers?:.*",
    r"Last updated by.*",
    r"Last modified by.*",
    r"Created by.*",
)

# Lines dropped when their stripped form matches, without regard to case.
LINE_NOISE_PATTERNS = (
    r"^Try$",
    r"^Footnotes$",
    r"^Source code:\s*$",
    r"^Was this page helpful\?\s*$",
    r"^Powered by GitBook$",
    r"^On this page$",
    r"^Copy$",
    r"^Ctrl\s+k$",
    r"^README$",
    r"^Getting Started$",
    r"^TypeScript Deep Dive$",
    r"^Future JavaScript Now$",
    r"^TypeScript's Type System$",
    r"^Project$",
    r"^Node\.js QuickStart$",
    r"^Browser QuickStart$",
    r"^Library QuickStart$",
    r"^JS Migration Guide$",
    r"^Errors in TypeScript$",
    r"^TypeScript Compiler Internals$",
    r"^Options$",
    r"^Testing$",
    r"^Tools$",
    r"^TIPs$",
    r"^NPM$",
)

# Sections naming people: heading up to the next blank line, the next line
# that starts with a letter, or the end. `^`/`$` are line ends, `.` is any
# character, case is ignored.
PEOPLE_SECTION_RULES = (
    (r"^contributors?:\s*$.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("contributor",)),
    (r"^authors?:\s*$.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("author",)),
    (r"^maintainers?:\s*$.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("maintainer",)),
    (r"^written by.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("written by",)),
    (r"^edited by.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("edited by",)),
    (r"^reviewed by.*?(?=\n\s*\n|\n[A-Z]|\Z)", ("reviewed by",)),
)

# Advertising, tracking, delivery, embedding and chat hosts.
BLOCKED_DOMAINS = (
    "googlesyndication.com",
    "googleadservices.com",
    "adservice.google.com",
    "ads.google.com",
    "pagead2.googlesyndication.com",
    "doubleclick.net",
    "amazon-adsystem.com",
    "adnxs.com",
    "appnexus.com",
    "criteo.com",
    "rubiconproject.com",
    "openx.com",
    "pubmatic.com",
    "conversantmedia.com",
    "contextweb.com",
    "google-analytics.com",
    "analytics.google.com",
    "googletagmanager.com",
    "mixpanel.com",
    "amplitude.com",
    "hotjar.com",
    "intercom.com",
    "inspectlet.com",
    "mouseflow.com",
    "userreplay.net",
    "fullstory.com",
    "loggly.com",
    "newrelic.com",
    "segment.com",
    "cdn.optimizely.com",
    "cdn.segment.com",
    "platform.twitter.com",
    "connect.facebook.net",
    "instagram.com",
    "liveperson.net",
    "surveymonkey.com",
    "typeform.com",
)

# File names (lower case) that contain one of these are index pages and the like.
SKIP_NAME_PARTS = (
    "genindex",
    "modindex",
    "py-modindex",
    "search",
    "404",
    "sitemap",
    "index-all",
    "glossary",
)
# The same for whole paths (lower case).
SKIP_PATH_PARTS = ("/genindex-", "/genindex.", "/modindex", "/py-modindex")

# Categories, in the order in which a path is tested for them.
KNOWN_CATEGORIES = ("typescript", "python", "cdk", "vue", "aws_design")
UNKNOWN_CATEGORY = "unknown"

# File names of these kinds are scanned, and so are names without any dot.
SCANNED_SUFFIXES = (".html", ".htm", ".md")

DEFAULT_TEXT_CAP = 120_000  # characters handed to the encoder
DEFAULT_DIM = 384  # vector length
DEFAULT_K = 5  # results per search
MAX_K = 10  # bound of the category-bound search
PREVIEW_CHARS = 1_500  # characters of text in a formatted result
SNIFF_CHARS = 2_048  # characters looked at to recognise HTML
TRUNCATION_MARK = "...(truncated)"
NO_RESULTS = "No results found."

# Session setting that overrides DEFAULT_TEXT_CAP.
TEXT_CAP_CONF = "pageloom.maxEmbedTextLength"


# --------------------------------------------------------------------------
# Parameter objects
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningRules:
    """Pattern lists used by ``clean_text``, each in the order of application."""

    css: tuple = CSS_RULES
    noise: tuple = NOISE_PATTERNS
    line_noise: tuple = LINE_NOISE_PATTERNS
    people_sections: tuple = PEOPLE_SECTION_RULES


@dataclass(frozen=True)
class Thresholds:
    """Smallest text that still counts as meaningful."""

    chars: int
    lines: int
    mean_line: int
    words: int


@dataclass(frozen=True)
class ContentPolicy:
    """General thresholds, and relaxed ones for one kind of page."""

    relaxed_domain: str = "docs.aws.amazon.com"
    relaxed_path_part: str = "/cdk/"
    general: Thresholds = field(default=Thresholds(chars=200, lines=10, mean_line=25, words=50))
    relaxed: Thresholds = field(default=Thresholds(chars=120, lines=6, mean_line=18, words=35))


@dataclass(frozen=True)
class ScanRules:
    """Which paths the scan keeps. ``base`` is the directory that holds the categories."""

    base: str
    blocked_domains: tuple = BLOCKED_DOMAINS
    skip_name_parts: tuple = SKIP_NAME_PARTS
    skip_path_parts: tuple = SKIP_PATH_PARTS
    suffixes: tuple = SCANNED_SUFFIXES


def embed_text_cap(spark: SparkSession) -> int:
    """Text cap from the session; a missing or malformed setting gives the default."""
    try:
        return int(spark.conf.get(TEXT_CAP_CONF, str(DEFAULT_TEXT_CAP)))
    except ValueError:
        return DEFAULT_TEXT_CAP
