"""Named presets for audio-feature tables.

The operators accept any key column and any list of numeric features; these
values only supply defaults for tables of songs.
"""

from __future__ import annotations

# Canonical feature order and the three feature sets.
AUDIO_FEATURES = [
    "danceability", "energy", "valence", "tempo", "loudness", "speechiness",
    "acousticness", "instrumentalness", "liveness", "mode", "key",
]
CONTINUOUS_FEATURES = [
    "danceability", "energy", "valence", "tempo", "loudness", "speechiness",
    "acousticness", "instrumentalness", "liveness",
]
ENCODED_FEATURES = CONTINUOUS_FEATURES + ["key_sin", "key_cos", "mode_sin", "mode_cos"]

# Period of each circular feature.
CIRCULAR_PERIODS = {"key": 12, "mode": 2}

# Fixed values: (low, high) display domain of each feature.
FEATURE_DOMAINS = {
    "danceability": (0.0, 1.0),
    "energy": (0.0, 1.0),
    "valence": (0.0, 1.0),
    "speechiness": (0.0, 1.0),
    "acousticness": (0.0, 1.0),
    "instrumentalness": (0.0, 1.0),
    "liveness": (0.0, 1.0),
    "tempo": (0.0, 200.0),
    "loudness": (-60.0, 0.0),
}

# Mood rules, first match wins. Each rule is
# (name, [(axis, comparison, bound), ...]) over the cluster means.
MOOD_RULES = [
    ("Energetic & Happy", [("energy", ">", 0.7), ("valence", ">", 0.6)]),
    ("Energetic & Intense", [("energy", ">", 0.7), ("valence", "<", 0.4)]),
    ("Calm & Peaceful", [("energy", "<", 0.4), ("valence", ">", 0.6)]),
    ("Melancholic & Sad", [("energy", "<", 0.4), ("valence", "<", 0.4)]),
    ("Danceable & Upbeat", [("danceability", ">", 0.7)]),
    ("Moderate & Balanced", [("energy", ">", 0.5), ("valence", ">", 0.5)]),
]
MOOD_DEFAULT = "Ambient & Atmospheric"
# Position of each rule axis in a cluster's mean vector.
MOOD_AXES = {"danceability": 0, "energy": 1, "valence": 2}

FEATURE_SETS = {
    "raw": AUDIO_FEATURES,
    "continuous": CONTINUOUS_FEATURES,
    "encoded": ENCODED_FEATURES,
}


def available(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    present = set(columns)
    return [c for c in wanted if c in present]
