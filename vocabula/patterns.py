"""Patterns of the free-text parser, in order of precedence. ASCII words and word ends; case is ignored unless marked."""

ITEM_TYPES = [
    (r"\buser\s+stor(?:y|ies)\b", "story", 0.95),
    (r"\bfeature\s+request\b", "feature", 0.9),
    (r"\bbug\s+(?:report|fix)\b", "bug", 0.9),
    (r"\bsub[- ]?task\b", "subtask", 0.95),
    (r"\binitiative\b", "initiative", 0.95),
    (r"\bepic\b", "epic", 0.95),
    (r"\bstor(?:y|ies)\b", "story", 0.85),
    (r"\btasks?\b", "task", 0.8),
    (r"\bbugs?\b", "bug", 0.85),
    (r"\bfeatures?\b", "feature", 0.8),
    (r"\bmilestones?\b", "milestone", 0.9),
    (r"\btickets?\b", "task", 0.7),
    (r"\bissues?\b", "task", 0.6),
    (r"\bwork\s+items?\b", "task", 0.6),
    (r"\bdefects?\b", "bug", 0.85),
    (r"\bthemes?\b", "initiative", 0.7),
    (r"\bgoals?\b", "milestone", 0.6),
    (r"\breleases?\b", "milestone", 0.7),
]
STATUSES = [
    (r"\bin\s+progress\b", "in-progress", 0.95),
    (r"\bin\s+review\b", "in-review", 0.95),
    (r"\bunder\s+review\b", "in-review", 0.9),
    (r"\bnot\s+started\b", "todo", 0.9),
    (r"\bready\s+(?:to\s+start|for\s+dev)\b", "todo", 0.85),
    (r"\bwon'?t\s+(?:do|fix)\b", "cancelled", 0.9),
    (r"\bto\s+do\b", "todo", 0.9),
    (r"\bbacklog\b", "backlog", 0.95),
    (r"\btodo\b", "todo", 0.9),
    (r"\bblocked\b", "in-progress", 0.7),
    (r"\bdone\b", "done", 0.9),
    (r"\bcompleted?\b", "done", 0.9),
    (r"\bfinished\b", "done", 0.85),
    (r"\bcancell?ed\b", "cancelled", 0.95),
    (r"\babandoned\b", "cancelled", 0.85),
    (r"\bpending\b", "backlog", 0.7),
    (r"\bactive\b", "in-progress", 0.7),
    (r"\bstarted\b", "in-progress", 0.75),
]
PRIORITIES = [
    (r"\bcritical\s+priority\b", "critical", 0.95),
    (r"\bhigh\s+priority\b", "high", 0.95),
    (r"\bmedium\s+priority\b", "medium", 0.95),
    (r"\blow\s+priority\b", "low", 0.95),
    (r"\bno\s+priority\b", "none", 0.9),
    (r"\bcritical\b", "critical", 0.8),
    (r"\burgent\b", "critical", 0.85),
    (r"\bblocker\b", "critical", 0.85),
    (r"\bblocking\b", "critical", 0.75),
    (r"\bhigh\b", "high", 0.6),
    (r"\bimportant\b", "high", 0.7),
    (r"\bmedium\b", "medium", 0.6),
    (r"\bnormal\b", "medium", 0.6),
    (r"\blow\b", "low", 0.6),
    (r"\bnice\s+to\s+have\b", "low", 0.85),
    (r"\bminor\b", "low", 0.7),
    (r"\btrivial\b", "low", 0.75),
]
#: These keep their case.
PRIORITY_CODES = [(r"\bP0\b", "critical", 0.95), (r"\bP1\b", "high", 0.9), (r"\bP2\b", "medium", 0.9), (r"\bP3\b", "low", 0.9), (r"\bP4\b", "low", 0.85)]
INTENTS = [
    (r"\b(?:create|add|make|build|implement|write|develop|set\s+up)\b", "create", 0.85),
    (r"\b(?:we\s+need|need\s+to|should\s+have|let'?s\s+(?:add|build|create))\b", "create", 0.8),
    (r"\b(?:new|introduce)\b", "create", 0.6),
    (r"\b(?:update|change|modify|edit|rename|move|reassign)\b", "update", 0.85),
    (r"\b(?:mark\s+as|set\s+to|change\s+to)\b", "update", 0.9),
    (r"\b(?:describe|define|explain|document|specification|spec)\b", "describe", 0.8),
    (r"\b(?:what\s+is|what\s+are|meaning\s+of)\b", "describe", 0.85),
    (r"\b(?:as\s+a\s+\w+,?\s+I\s+want)\b", "describe", 0.9),
    (r"\b(?:find|search|list|show|get|where|which|look\s+up)\b", "query", 0.85),
    (r"\b(?:how\s+many|what'?s\s+the\s+status)\b", "query", 0.9),
    (r"\b(?:break\s+(?:down|into|up)|decompose|split|divide)\b", "decompose", 0.9),
    (r"\b(?:consists?\s+of|includes?|contains?)\b", "decompose", 0.7),
]
PERSONS = [
    r"\bassigned?\s+to\s+(\w+(?:\s+\w+)?)\b",
    r"\bowner:\s*(\w+(?:\s+\w+)?)\b",
    r"\b(?:for|by)\s+@?(\w+(?:\s+\w+)?)\b",
    r"@(\w+)\b",
    r"\breported\s+by\s+(\w+(?:\s+\w+)?)\b",
    r"\bfrom\s+(\w+(?:\s+\w+)?)\b",
]
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{1,2}(?:,?\s+\d{4})?"
DATES = [
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b((?:next|this)\s+(?:week|month|quarter|sprint))\b",
    rf"\b((?:by|due|before|until)\s+(?:{_MONTH}))\b",
    rf"\b({_MONTH})\b",
    r"\b(\d{1,2}\/\d{1,2}\/\d{2,4})\b",
]
LABELS = [r"\blabels?:\s*(\w+(?:,\s*\w+)*)\b", r"\btags?:\s*(\w+(?:,\s*\w+)*)\b", r"\[(\w+(?:[-/]\w+)*)\]", r"#(\w+(?:[-_]\w+)*)\b"]
COMMON_WORDS = frozenset(
    (
        "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can "
        "this that it them they we you me my your our their his her its all each every some any no not task tasks story stories epic bug feature new next week month sprint"
    ).split()
)
TYPE_NAMES = "initiative|epic|story|task|subtask|bug|feature|milestone"
CHILD_TYPE = {"initiative": "epic", "epic": "story", "story": "task", "task": "subtask", "subtask": "subtask", "bug": "task", "feature": "story", "milestone": "epic"}
MIN_ENTITY_CONFIDENCE = 0.3

#: Lines of lists, titles with a type before them, user stories, and lines that only introduce what follows (fixed values).
LIST_ITEM = r"^(?:[-*•]|\d+[.)])\s+(.+)$"
LIST_MARK = r"^(?:[-*•]|\d+[.)])\s+"
TYPED_TITLE = rf"^({TYPE_NAMES})[:\-]\s*(.+)$"
BRACKETED_TITLE = rf"^\[({TYPE_NAMES})\]\s*(.+)$"
USER_STORY = r"^as\s+a\s+\w+(?:\s+\w+)*,?\s+I\s+want\s+.+$"
STORY_GOAL = r"as\s+a\s+\w+(?:\s+\w+)*,?\s+I\s+want\s+(.+?)(?:,?\s+so\s+that\s+(.+))?$"
META_LINE = r"^(?:create|add|here\s+are|the\s+following|these\s+are|list\s+of)\b.*[:]\s*$"
META_PREFIX = r"^(?:create|add|make|build|implement|write|develop|we\s+need)\s+(?:a\s+(?:new\s+)?)?"
