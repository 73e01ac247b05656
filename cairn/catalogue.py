"""Values that results must agree on: names, sizes and limits."""

# Record states.
PENDING = "pending"
ACTIVE = "active"
DONE = "done"
TASK_STATUSES = (PENDING, ACTIVE, DONE)

# Assessment types and their score domains, in display order.
BDEFS = "bdefs"
STROOP = "stroop"
BISBAS = "bisbas"
ASSESSMENT_TYPES = (BDEFS, STROOP, BISBAS)
BDEFS_DOMAINS = (
    "Time Management",
    "Organisation & Problem-Solving",
    "Self-Restraint",
    "Self-Motivation",
    "Emotion Regulation",
)
BIS = "Behavioral Inhibition (BIS)"
DRIVE = "BAS Drive"
REWARD = "BAS Reward Responsiveness"
FUN = "BAS Fun Seeking"
BISBAS_DOMAINS = (BIS, DRIVE, REWARD, FUN)
DOMAINS = {BDEFS: BDEFS_DOMAINS, BISBAS: BISBAS_DOMAINS}
ITEMS_PER_DOMAIN = {BDEFS: 3, BISBAS: 5}
RESPONSE_MIN = 1
RESPONSE_MAX = 4

# Reaction test.
COLOURS = ("red", "green", "blue", "yellow")
AVG_TIME_KEY = "avg_time_ms"

# Input limits.
TITLE_MAX = 500
MINUTES_MAX = 120
JOURNAL_LIMITS = {
    "values_focus": 1500,
    "challenge_context": 2500,
    "thoughts_feelings": 2500,
    "defusion_reframe": 2500,
    "committed_action": 1500,
}

# Advice bands per questionnaire, low to high.
BANDS = {
    BDEFS: ("minimal", "mild", "moderate", "high"),
    BISBAS: ("low", "moderate", "high"),
}

# Cut points of bands and readings, in percent or milliseconds.
QUARTERS = (25, 50, 75)
TRAIT_LOW, TRAIT_HIGH = 50, 75
ANXIETY_LOW, ANXIETY_HIGH = 40, 75
WHOLE_LOW, WHOLE_HIGH = 33, 66
ACCURACY_CUTS = {"excellent": 90, "good": 70, "moderate": 50}
SPEED_CUTS = {"fast": 1000, "average": 2000}

# Cut points of the profile, in percent or milliseconds.
DIFFICULTY_SEVERE, DIFFICULTY_SOME, DIFFICULTY_LITTLE = 75, 50, 30
WEAK_ACCURACY, WEAK_MS = 65, 2200
SHARP_ACCURACY, SHARP_MS = 90, 1200

# Minutes of the profile.
FOCUS_CAREFUL, FOCUS_EAGER, FOCUS_SHORT = 10, 20, 12
BREAK_LONG, BREAK_LEAST = 6, 4


def domain_max(kind: str) -> int:
    """Highest raw score of one domain."""
    return ITEMS_PER_DOMAIN[kind] * RESPONSE_MAX


def domain_floor(kind: str) -> int:
    """Lowest raw score of one fully answered domain."""
    return ITEMS_PER_DOMAIN[kind] * RESPONSE_MIN


def total_max(kind: str) -> int:
    """Highest raw total of a questionnaire."""
    return domain_max(kind) * len(DOMAINS[kind])


def total_floor(kind: str) -> int:
    """Lowest raw total of a fully answered questionnaire."""
    return domain_floor(kind) * len(DOMAINS[kind])
