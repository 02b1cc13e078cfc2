"""Job parameters: labels, decision thresholds, priors and switches.

Everything here is a plain frozen dataclass; operators turn the values into
literals inside the Spark plan, so a config change never needs a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the screened behaviour exactly.
# Label names and their canonical output order.
LABELS: tuple[str, ...] = (
    "Advertisement/Promo",
    "Irrelevant Content",
    "Rant (Likely Non-Visitor)",
    "Spam/Low-quality",
)
AD, IRRELEVANT, RANT, SPAM = LABELS
# Short column-safe names used for probability columns (p_ad, p_irr, ...).
LABEL_KEYS: tuple[str, ...] = ("ad", "irr", "rant", "spam")
# Built-in profanity lexicon used when no lexicon file is given.
DEFAULT_PROFANITY: tuple[str, ...] = ("damn", "hell", "crap", "stupid")
# Constant rationale attached to every prediction record.
RATIONALE = "Rules + model + priors (username, images, burst/dup, location, profanity, readability)."
# Spam probabilities raised by each prior.
SPAM_RAISE_USERNAME = 0.6
SPAM_RAISE_IMAGE = 0.7
SPAM_RAISE_BURST = 0.6
SPAM_RAISE_DUP = 0.7
SPAM_RAISE_ENTROPY = 0.6
SPAM_RAISE_PROFANITY = 0.55
# Experiential score below which a review counts as "not experiential".
EXPERIENTIAL_LOW = 0.2
# Relevancy cut used by the profanity prior (not configurable).
PROFANITY_RELEVANCY_CUT = 0.3
# Earth radius in km for haversine.
EARTH_RADIUS_KM = 6371.0
# Vocabulary caps of the two TF-IDF vectorisers.
CLASSIFIER_VOCAB = 20000
RELEVANCY_VOCAB = 50000
# Images considered per review for image relevance.
MAX_IMAGES = 5
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Priors:
    username_gibberish_to_spam: float = 0.8
    image_irrelevant_to_spam: float = 0.1
    image_low_to_irrelevant: float = 0.2
    burst_24h_to_spam: int = 5
    low_entropy_to_spam: float = 2.5
    far_km: float = 100.0


@dataclass(frozen=True)
class Switches:
    enable_image_relevance: bool = True
    enable_username_prior: bool = True
    enable_dup_burst_prior: bool = True
    enable_device_location_prior: bool = True
    enable_profanity_prior: bool = True
    enable_readability_prior: bool = True


@dataclass(frozen=True)
class Thresholds:
    ad: float = 0.5
    irr: float = 0.5
    rant: float = 0.5
    spam: float = 0.5
    rel_thresh: float = 0.3

    def as_dict(self) -> dict[str, float]:
        return {AD: self.ad, IRRELEVANT: self.irr, RANT: self.rant, SPAM: self.spam}


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.1
    val_size: float = 0.1
    random_state: int = 42


@dataclass(frozen=True)
class ScreenConfig:
    priors: Priors = field(default_factory=Priors)
    switches: Switches = field(default_factory=Switches)
    thresholds: Thresholds = field(default_factory=Thresholds)
    # Burst window bucket width: rows are split by (user, time bucket) so a
    # single hot user never lands in one task. Minutes dividing 1440, or "auto"
    # to size buckets from the data (partially aggregated counts).
    burst_bucket_minutes: int | str = 240
    # Date patterns tried for created_at texts that no general rule reads.
    date_formats: tuple[str, ...] = ()
