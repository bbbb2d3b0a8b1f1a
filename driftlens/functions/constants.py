"""Word lists and weights that fix exact results."""

CHANNELS = (("strings", 0.30), ("writes", 0.30), ("name", 0.22), ("calls", 0.10), ("ret", 0.08))
ANCHOR_NAME = 0.34
DELEGATE_FACTOR = 0.2
ROLE_PREFIXES = "apply build check compute do get handle make maybe on process resolve run try".split()
STEM_STOPWORDS = "a an and for of or the to".split()
INVERSE_SEARCH = "bisect closest find intersect invert locate lookup nearest project search solve".split()
FORWARD_MAP = "eval evaluate interpolate lerp sample transform".split()
MEASURE = "area continuity count curvature deviation distance error length measure metric norm residual score".split()
OPPOSED = [
    p.split("/")
    for p in (
        "acquire/release add/delete add/remove attach/detach begin/end collapse/expand complete/start connect/disconnect create/delete create/update decode/encode "
        "decrement/increment delete/insert deserialize/serialize disable/enable end/start enter/exit get/set hide/show insert/update link/unlink lock/unlock mount/unmount "
        "open/close pop/push read/write register/unregister start/stop"
    ).split()
]
GENERIC_TYPES = (
    "Any Arc Array AsyncIterable AttributeError Awaited BTreeMap BTreeSet Box Buffer Callable ClassVar Clone Collection Copy Cow Date Debug Default Dict Display Enum Eq Error "
    "Exception Exclude Extract Final Flag FrozenSet Generator Generic Hash HashMap HashSet IndexError IntEnum IntFlag Item Iterable Iterator JSON KeyError List Literal Map "
    "Mapping MutableMapping MutableSequence Mutex NamedTuple NoReturn Object Omit Option Optional Ord OsString Output Parameters Partial PartialEq PartialOrd PathBuf Pick Promise "
    "Protocol Rc Readonly ReadonlyArray Record RefCell RegExp Required Result Returntype RuntimeError RwLock Self Send Sequence Set StopIteration String Sync Tuple Type TypeError "
    "TypedDict Union ValueError Vec WeakMap WeakSet"
).split()
COMMON_CONSTS = (
    "ALL ANSIC CSV DEFAULT EMPTY EPSILON FRAC_1_PI FRAC_1_SQRT_2 FRAC_PI_2 FRAC_PI_3 FRAC_PI_4 FRAC_PI_6 FRAC_PI_8 HTML INF INFINITY JSON LN_10 LN_2 LOG10_E LOG2_E MAX "
    "MAX_SAFE_INTEGER MAX_VALUE MIN MIN_POSITIVE MIN_SAFE_INTEGER MIN_VALUE NAN NEG_INFINITY NONE O_APPEND O_CREATE O_EXCL O_RDONLY O_RDWR O_SYNC O_TRUNC O_WRONLY RFC1123 "
    "RFC3339 RFC3339NANO RFC822 SQRT_2 TAU TOML UTF8 XML YAML"
).split()
COMMON_IDENTS = (
    "append append_ bool byte cap close complex complex128 complex64 copy delete dict enumerate error extend false filter float32 float64 format getattr hasattr imag int int16 "
    "int32 int64 int8 iota isinstance issubclass items join keys len list make map new nil panic print println range real recover repr reversed rune set setattr sorted split str "
    "string strip super true tuple uint uint16 uint32 uint64 uint8 uintptr update values zip"
).split()
#: tried in this order; izations before s, ization before tion, esses and ies before es before s
SUFFIXES = "able ible ment ly est er ed ing izations ization esses ies es s sion tion".split()
SYNONYM_STOP = (
    "about after also although another back because been before between both came comes could during each even felt feel from gets give given goes going have however into itself "
    "just knew know known less like look looked looks made make many more most much only other ourselves same seem seems should show shows since some still such take taken than "
    "that their them themselves then there these they this those though through thus until used uses using very well were what when where which while with would"
).split()
IRREGULAR_GROUPS = (
    "found find finds finding/held hold holds holding/made make makes making/said say says saying/thought think thinks thinking".split("/")
)
IRREGULAR_STARS = "ran:run runs running/seen:see sees seeing/kept:keep keeps keeping/paid:pay pays paying/sold:sell sells selling/died:die dies dying/won:win wins winning/cannot:can't/woman:women/three:third/death:die dies dying/dies:dying".split("/")
TEST_DIRS = "tests test __tests__ testdata __mocks__".split()
SKIPPED_DIRS = ".git node_modules vendor dist build target .venv __pycache__ testdata".split()
PROSE_EXTENSIONS = "md markdown mdx txt rst".split()
CONSTRAINT_LEADERS = "CHECK CONSTRAINT EXCLUDE FOREIGN INDEX KEY PRIMARY UNIQUE".split()
ROUTE_FILES = [f"+{stem}.{ext}" for stem in ("layout", "layout.server", "page", "page.server", "server") for ext in ("js", "ts")]
ROUTE_NAMES = "DELETE GET HEAD OPTIONS PATCH POST PUT actions load".split()
#: \b over ASCII words; Java's own is Unicode-aware
ASCII_B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
COMPOUND = r"[a-z][a-z0-9]*(?:[-/][a-z][a-z0-9]*)+"
CONTENT_WORD = r"[a-zA-Z][a-zA-Z']{3,}"
CONFESSION = (
    r"(?i)" + ASCII_B + r"(mirror(?:s|ed|ing)?|(?:keep|kept)[ -]in[ -]sync|keeps? (?:it )?in sync|stay(?:s|ed) in sync|kept consistent|must (?:match|agree)|in lockstep|"
    r"parallel to|duplicates? of|copy of|copied from|cross-checked|single[ -]source(?:d| of truth)?)" + ASCII_B
)


def irregular_pairs() -> set[tuple[str, str]]:
    """Unordered pairs of forms of one word that suffixes do not give away, as sorted tuples."""
    out = set()
    for group in IRREGULAR_GROUPS:
        forms = group.split()
        out |= {tuple(sorted((a, b))) for i, a in enumerate(forms) for b in forms[i + 1 :]}
    for star in IRREGULAR_STARS:
        head, _, rest = star.partition(":")
        out |= {tuple(sorted((head, w))) for w in rest.split()}
    return out
