"""The fixed values every operator shares."""

# --- fixed values -----------------------------------------------------------
# Labels, thresholds and word lists that results must agree on.

VIDEO_EXTENSIONS = ["mp4", "webm", "mov", "mkv", "avi", "m4v"]

SCENE_LABELS = [
    "teacher at a whiteboard",
    "slide presentation",
    "laboratory experiment",
    "student discussion",
    "diagram explanation",
    "demonstration with equipment",
    "animated visualization",
    "text-heavy slide",
    "person talking to camera",
    "handwritten notes",
    "3d rendered animation",
    "cartoon for children",
    "letter or word flashcard",
    "cooking or kitchen demonstration",
    "live-action people indoors",
    "nature or animal illustration",
]

REALWORLD_SCENES = [
    "laboratory experiment",
    "demonstration with equipment",
    "person talking to camera",
    "teacher at a whiteboard",
    "student discussion",
    "cooking or kitchen demonstration",
    "live-action people indoors",
]

TEXTY_SCENES = [
    "slide presentation",
    "text-heavy slide",
    "handwritten notes",
    "diagram explanation",
    "letter or word flashcard",
]

DIFFICULTIES = ["beginner", "intermediate", "advanced", "expert"]

STAGES = ["ingest_audio", "route", "extract_frames", "visual", "segmentation", "llm", "store"]

TRANSIENT_ERRORS = [
    "OperationalError",
    "DisconnectionError",
    "InterfaceError",
    "ConnectionError",
    "ConnectionResetError",
    "TimeoutError",
    "gaierror",
    "RedisError",
    "BrokenPipeError",
    "ReadTimeout",
    "APIConnectionError",
]

CORE_TAG_FIELDS = [
    "topic",
    "subject",
    "grade_level",
    "difficulty",
    "content_type",
    "tags",
    "subtopics",
    "summary",
    "confidence",
]

TAG_STRING_FIELDS = [
    "topic",
    "subject",
    "grade_level",
    "difficulty",
    "content_type",
    "summary",
    "speaker_role",
    "language",
]

SILENCE_DB = -50.0
NO_AUDIO_DB = -99.0
MIN_SPEECH_SEC = 3.0
WINDOW_SEC = 30.0
MIN_SEGMENT_SEC = 45.0
MAX_SEGMENT_SEC = 120.0
MAX_SEGMENTS = 12
DROP_FALLBACK = 0.25
DROP_FLOOR = 0.15
SCENE_CUT_SCORE = 0.3
MAX_FRAMES_VOICE = 18
MAX_FRAMES_SILENT = 40
CAPTION_FRAMES = 12
OCR_FRAME_CHARS = 500
OCR_SEGMENT_CHARS = 600
CAPTIONS_PER_SEGMENT = 4
ERROR_CHARS = 2000
RRF_K = 60
GATE_ABS_FLOOR = 0.18
GATE_REL_RATIO = 0.75
HEARTBEAT_MAX_AGE_SEC = 60
MAX_RETRIES = 5
PAGE_SIZE = 25
PAGE_SIZE_MAX = 200
SEARCH_LIMIT_MAX = 100
DEFAULT_TOPIC = "Sample Lesson"
UNTITLED = "untitled segment"
REASON_EXISTS = "already processed (use force=true to reprocess)"
REASON_DUPLICATE = "byte-identical to an existing video"
REASON_NEW = "new content"
RULE_SUBJECT = "General Knowledge"
RULE_GRADE = "Grade 1-2"
RULE_SUMMARY = "Auto stub summary for: "
RULE_WORD = "[A-Za-z][A-Za-z'-]+"
PARSE_ERROR_CHARS = 300
PROMPT_TEXT_CHARS = 3000
PROMPT_OCR_VOICE_CHARS = 300
PROMPT_OCR_SILENT_CHARS = 400
TOP_KEYWORDS = 20
TOP_ENTITIES = 40
PHRASE_MIN_CHARS = 2
PHRASE_MAX_CHARS = 40
BOARD_SIZE = 12
RECENT_JOBS = 20

# English words that never begin, end or fill a keyphrase (Spark's default list, words of letters only).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now cannot could ought would
""".split()
# --- end of fixed values ----------------------------------------------------
