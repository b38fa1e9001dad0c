"""Common English words, most usual first: those of the prose of at least three modules of the Python libraries, and everyday ones."""

COMMON = """\
the and for with that are from class value not this will default object data values function string name optional can
used array type which column list return import all dtype pyspark file use int given method when index number set
param bool one versionadded only input each spark should self new specified same result columns using must have into
numpy path any instance may other but first model returns argument schema its has names returned then axis meth output
where see elements arguments functions you than order tuple also module version key passed code objects more time
doctest two line format types example ndarray case parameter dict single text called integer field call pandas element
current error message sequence does whether shape func length float strings containing bytes arrays either was
versionchanged exception dictionary source def attribute rows information node instead last size otherwise over like
before provided attr level such after series test defined directory methods table copy row empty details there fields
they expression mode both multiple files between out characters scalar end options boolean group keyword contains
without true keys match valid different along following item user based read option raise found datetime raised
support indices memory corresponding parameters most some lines equal position created representation idx
implementation equivalent attributes original start context deprecated supported left converted buffer character label
matrix within labels means available pass null their target encoding items header create uses window classes them
callable check point always being been would variable right these get operation binary possible missing metadata
except range part pattern col generated style results already cannot standard request required need base points
include defaults representing contain iterator resulting note sorted second math else command state another date
maximum through obj form server because stream zero behavior unique local mapping matches named run want process axes
numbers ser change protocol how coefficients dataset query ref categories try write operations including event kwargs
errors present existing mask added system block inputs timestamp expected frame complex useful add below args
underlying reference raises distribution directly filename width configuration connection work python package
copyright while pygments times instances removed arr just matching variables license subclass calls tuples warning
widget pyarrow offset compute sort turtle during calling takes about color internal convert specify team make since
iterable integers full via special allowed sys could map per numeric dtypes applied response apply whose stored
negative specific even view invalid exists partition custom statement parent ignored documentation strategy false
minimum written lambda way validation dimension every polynomial future precision count least mean lists necessary
allows entries dimensions unless those alias computed interface your less relative many needed ordered once root above
allow compatibility pairs considered extra socket weight operator levels sets were parsing access real cases
descriptor generate days back currently day masked represents provides regular next common headers display appropriate
what against pytest prefix requests running here namespace environment contents stack cache nodes treated typing
automatically define extension setting side bar tag supports arg until place address content product vector compatible
take config handle timeout entry large constructor recent itself sum pair long serialization tree parsed well
sequences nested frequency plot examples associated additional bound engine usage library included according timezone
section location sample provide manager exist slice implement fill specifying indicating parse under handler lexer
decimal info encoded hook regex writing etc session exceptions done join database features similar versions language
token thread literal year open tensor flag positive still find syntax byte random runtime conversion core console
graph reading represent property inferred limit total assert identifier greater algorithm simple rather pydantic
replaced inside seconds own weights parser decorator caller now condition global explicitly three old foo interval
avoid arbitrary definition execution returning categorical changes dates store loop specifies ints messages search url
feature works collection passing body log replace compression made space record difference actual absolute depending
closed creating contained particular perform control entire requires tests very temporary wrapper determined executed
indicates expressions blocks split doc accepted modules tempfile quantization document performance around override raw
might generator host tags exactly whitespace known top kind rank params external references digits speed scope paths
print domain initial batch subset checks comparison groups tokens partitions supplied properties yield settings static
formatted previous too final ones selection implemented never description pool age filter dataframe generic hash
installed ensure title month taken selected our step users zone lower positional signature includes determine together
shared needs image rtype requested height docs release performed stop flags requirement struct produce category small
filled addition separator fit keep rules specification callback logging annotation task duplicates operators traceback
build across resource indexes codes padding normal cause enabled handling screen indexing correct bins logic streaming
fixed changed accepts indexer pickle fully cast validate help docstring annotations platform subclasses structure
compare floating high proxy plugin models effect trailing wrapped follows distributions degree unicode port
directories attempt child fixture described remove terms fails loaded degrees scale evaluated aliases max ignore
registered later occurs leading having main formatting vary certain assumed refer enum related github spaces active
assigned warnings ascending validator flattened keywords parts larger select sent scheme defines inverse omitted
appear words gives dataclass checking desired send matplotlib depends strict transform update json smaller various
whole evaluation nullable records starting testing save application complete explicit client serialized show unchanged
usually intended terminal double theme mat formats constant possibly term separate low relation actually imported
member creates operand typically program linear represented appended fail produced makes immediately replacement none
highest builtin beginning coordinates individual due status archive component conftest processing components repeated
modify unit outputs bin optionally chunks calculate iteration freq internally remaining general min applies close bits
formatter sign union definitions variance outside coefficient abstract something starts duplicate requirements forward
require connections compressed quantile floats occurrence wrap suitable timestamps exclude writer nothing counts
average places mark delimiter holds device better exc link diagonal calculation progress logger cat vectors
collections modified interpreter bounds checked events machine transformed applying correctly seed quantized container
much threads matched char qualified rolling attrs hypothesis scalars renderable multiplication upper indicate
functionality skip plugins meaning anything smallest interpreted reads word invoked copied filesystem normalized wheel
cached correlation metrics exact dog adds compared chunk accept years summary look assignment samples platformdirs
implementations zeros implements recommended backend behaviour longer background broadcast depth printed decoded basis
polynomials followed nan roots disk private merged saved several backward positions tied helper handled newline basic
cursor escape construct evaluate load layout unsigned occur failure simply inner structured yet mod week further
amount rule inspect observations commands converting box compiled separated signal respectively corresponds opened
locale styles extract higher inplace reader grouping best merge storage updated specifier off tasks clause font torch
safe timedelta though power creation append break accessed statistics infer singular midx training calculated quantize
lock mapped render deviation project animal ordering adding spec cell sorting descending threshold logical insert
again sure exit decorated runs suffix resolution shown repr handles implementing lowest inserted public collected
members bit boundary shrink unknown down generating packages failed dot periods cookies inclusive alpha overridden
however mammal guaranteed therefore contiguous packaging sparse enable identical faster controls started disabled
script locations distinct native err tolerance validators falcon pos patterns interpolation hours semantics derived
working suite yields page validated cols onnx consider decode gets months master colors histogram built policy encode
service frames outer globals symbol origin preserve drop grouped accessor partitioning stderr consecutive execute
legacy edge move processed recursively initialized overrides wrapping maps combination skipna got largest direction
extensions thing generally descriptors making approximate preserved pip cumulative marker bird reverse numerical val
writes comments epoch charset regression scipy groupby mixed received conditions report constants differences quoted
refers proto aggregation psser queue dicts action preferred children mailbox deleted operands short factory choices
offsets placed initializer pickled inference nearest exponent reason square excluded const comment async accuracy able
potentially angle locals drawn filters signed giving copies readable decoder statements stdout constructed span
displayed ambiguous filling symmetric prompt disable embedded markup lookup network cells verify slices hold wait
subprocess connect install dialog independent aggregate matrices org occurred give equality defining constraints
excluding switch typed changing combined previously draw variant thus expanding listed configured division tab indent
resolve trace resources mechanism grid profile evaluator become coroutine reduced shows good substring successfully
probably extended handlers provider tensors follow register obtained truncated chosen issue thrown indexed generates
sizes plan dropped relevant trying destination debugger often dictionaries immutable email addresses skipped choice
highlight retry namedtuple schemas dimensional applicable arithmetic others consists alternative prevent describing
setup evaluates increasing extracted reserved password distributed mouse mock factor ufunc purposes shift decoding
themselves likely strictly know share dynamic period casting ndarrays fitted infinity ignoring reset computation upon
newlines predicate complexity ctypes processes convenience ends expect correspond reduce languages intervals discrete
normally plus integral happens problem emitted occurrences quotes remote converts generation segments area
experimental nor looks computing please encountered meta printing responsible providing literals approach guide
candidate performs certificate loading checker cluster deg sources assume dependent wraps doing plain serialize median
zstandard had third visible consumed updates dependencies pipeline button consistent monkey satisfy hashable mutable
raising deep pad buffers encoder marked holding cookie authentication strategies metaclass neither newly backwards
dependency force combine lowercase efficient stable forms highlights batches continue virtual precedence pretty unlike
systems kept produces fewer expensive shell unused gap bias endif serializer debugging rounding taking subject segment
completed tables hex capture aligned edges eigenvalues regardless fallback transport free steps earlier hidden channel
captured rest determines boundaries direct delete enough building catalog highlighting probability observation things
notation designed undefined storing template breakpoint converter among transformation becomes whenever round
everything routine meant expects splits receive iterate gencodec detect chain hierarchical identity checkers
partitioned units reduction quantiles psidx duration overflow come assumes priority codec replacing past menu
specifiers circle retries four var registry terminated indicated interactive allowing prints booleans lineno replaces
indentation rendered weighted dense covariance minimal few libraries figure keeps optimization datatype retrieve
issues falls redirect candidates conf identified comparing sep comma failing onto typ population pat iterations align
algorithms escaped appears introduced referenced prior filenames concatenation especially resolved pathname letter
binding region canvas imaginary commit scaling numba retrieved depend finite towards construction passes proper
coordinate limited duplicated rectangle clipboard driver calculations klass norm datasets detail platforms
milliseconds important quote subsequent family waiting copying verbose inherited operate distance tokenizer shapes
scaled percentile tools shallow expressed choose executable looking finished attempts proxies bases rich combinations
fall identifiers compressor intersection transpose ddof rounded digit tries seen barrier equals properly leads purpose
inf observed routines gateway coef recognized explanation formed treat dummy really insertion affect easy selector
cancelled flow hooks integration aware windows optimized estimate stats multidimensional datetimes pairwise dropna
unsupported intermediate padded unspecified put initialization worker job ways detailed hints removing removes lazy
stage classification squares recursive did classmethod elif parallel invoke executing dialect computes ranges
unexpected notes account documents bitwise transforms uppercase assertion fixtures tzinfo differ yielding ensures goes
partial recursion ids implicitly enables flexible links wrong pathlib constraint sampling nonexistent triangle
comparisons latter necessarily lengths modes clear fast happen selects expanded problems frozen loader subtype
hostname underscore moved track assign views center lion jar evolving microseconds hour remainder leave reported going
automatic builtins grammar finally bind showing causes obtain trigger convenient importing improve continuous
horizontal summation unbiased protobuf buf plotting calibration lexers incompatible queries yielded concrete
fractional naive loss canonical inherit reached behaves initialize decorators prog accessing conn num anchor fragment
omit sub filtering widgets namespaces sheet converters quarter spaced plotly closest normalization implicit iff usual
manually separately iterables dataclasses cost sentinel failures filtered rate overlap configure stdlib allocated swap
builder red effective streams instantiating concatenated schemes markers blank stripped presence portion major
declared scripts heap performing recommend deprecation parrot styler compiler silently del structures modification
overload older accessible dir pointing describe alive opening sides front symbolic ops extras joined expand
programming declaration mypy decimals len uuid keepdims prediction shield attached payload completion reasons parents
tabs callbacks fetch partially convention prefixed capturing drawing degradation propagate hierarchy slicing leaf
angles pypi stacked labeled successful asynchronous attempted exclusive truncate normalize alignment usable lead
writable mainly keeping validating located identify human respect bottom moving importlib percentage supporting
infinite nonzero representations quite guarantee ready overhead bug arrow instantiated dump behave turn counted
conditional conventions suppress mostly managed export respective inline pointer mismatch providers throw backed
attention divisor noqa ndim serious transposed fun squared estimator initializers discriminator slow identifying
middle calculating implies mappings docstrings registration utility completely brackets opcode breaks searched
intercept sense primary maintain collect combining determining overwrite username keyed vertical renamed baz listener
consistency dateutil broadcasting parquet checkpoint percentiles subgraph dynamically calendar discarded detected
natural hint connected hide finds act phase defaulting locally flat hexadecimal selecting hence enc seealso zones
throws aggregations contraction fitting prereleases cow weekday bad approximation inserting site applications leaving
lost garbage deal whereas correspondence easier abc browser comes shrinking overwritten scopes bold nanoseconds
reshape goto loc auth distro tool builds tested significant buffered whatever kernel instantiate attempting sends
retained interpret aggregated controlled fact hand remain fraction physical extend serializing assignments rendering
overlapping neg releases documented ordinal conversions representable translated far backslash manner stores augmented
sending await sensitive customize differs safely specialized parentheses customized preserves memo frequencies turns
jump dotted installation iterating saving enclosing singleton highlighted belongs cross collector measured regexp
elementwise justify activations divide although layer readline overriding subclassing chars debug states solution
instantiation sometimes reused diff clusters escapes retain describes software let patch suffixes classname cond fits
invocation estimated exposed beta focus shuffle analysis autosummary toctree onnxruntime predictions resolver uniques
jobs reflect ratio encodings affected beyond consisting meaningful feed asyncio broken tells big getting blocking
runner minutes limits weak uncompressed finding primarily slightly shorter appropriately colon minor web idle
constructing interchange met convertible latest caching bigint downloaded derivative pixels indexers blue colormap
animation caused adjusted thousands appending non assuming notice threading delay cycle wide containers score prefixes
bytecode matter nice editor zip symbols owner midnight strides decomposition optimal masks equation vocabulary strip
minute signals odd inexact floor cleanup consist executor enabling primitive puts framework potential stops incorrect
decide unpack referred commonly white branch invokes indicator enforce foreground wish products cosine adjust corner
ufuncs sink minus near almost bare actions exits generators idea decompression temporarily compound constructs init
producing border displays bugs repository wrappers receives precise exponential unset subscript lexicographically
transformations trim metric enumerate sampled timeseries env distutils logarithm separators buffering codecs ending
signatures searching entered avoids leaves breaking composite managers finder annotated parses utilities letters
decompressed domains reflected magic dist consume sliced roundoff plots cobra subplots req java imports unavailable
multiplied modulo guarantees compact care design loops twice soon repeatedly closing slot success breakpoints encodes
introspection marks concatenate monotonically namedtuples remains fileobj easily appearance spans hashes codepoint
pivot pre stub importance decreasing diagonals vectorized gradient activation notebook viper sidewinder compile gzip
compares iterated piece incomplete restore post affects caught callables fix cleared prepended chunksize executes lib
reports restriction anywhere reporting ctype half glob say sorts merging folder repeat circular kwarg conjunction
formatters modifying topmost modname consulted shall transition compat deterministic ties dev density consumption
companion mapper spinner roughly conform unbounded issued elsewhere helps seq sockets endpoints counter timer
alternate live evaluating head membership ordinary spacing splitting verbosity fine transfer differently functools
emit supposed unpacked truth uniform coerce sentence ind fortran multiplicity residuals ranks parsers acts formal
exceeds recorded sequential trees finish interfaces unittest res profiler begin tracebacks triples symlinks void
turned entirely advanced satisfies paragraph zipfile globally serializable credentials practice bars repl rec stages
acc widths evenly autoattribute ifdef fly caption heading emoji sec declarations unary purely truncating numerically
shifted falling implied preceding argparse defer increase forces counting clean catch interpretation fresh sections
substrings accordingly inspired pickling perhaps bindings delta hyperbolic edit interesting attach multipart answer
hashing relationship guess tooltip rights specifications packed succeeds pep meet parametrized backport oneof
broadcasted unions resampling sliding heads dogs cert bytearray caches restrictions refresh transformer wants endpoint
protocols app shortcut receiving propagated linearly rightmost delimiters enclosed databases adjacent tried flatten
similarly transforming ignores vertically reversed who lazily backoff trimmed processor rename resolving effects
finalizer independently teardown parametrization untrusted narrowing bundle summed pixel dta cats boxplot clustering
polygon architecture sufficient nonnegative varies history drive cancel reuse simultaneously acceptable sessions
topics subdirectories indented surrounded fname excel mess considering similarity timezones images preference
unpickling essentially ask fastest stopped supply responses newer particularly opposite developer nesting adapter wire
accumulated thought clauses egg dimensionality upgrade stateful improvements bools downcast monotonic grouper country
locator sourcecode permission displaying truncation pending logged invoking mix rely shutdown hosts undo pid alphabet
shorthand collecting repeats naming covers optimize uniquely terminate exported originally printable illegal push
mutate digest soft localhost populated alone improved warn backing extends embedding avoided manage frequent sine
black download hardware holidays eps resultant wise convolution factorization xdeg percent algo holes datetimelike
buckets graphics persistence registering away moment pipe flush prefer directives prevents slots populate integrate
scheduled accepting reasonable concurrent coroutines kernels insensitive careful looked delimited triggered hard
quickly begins medium accurate recognize compliant iterates six cycles discard chained inherits early footer sees
abbreviation expr distribute relies achieve solved succeed bucket spelling swapped radians pack appname proportional
forced dropping disables satisfied tangent byteorder chunked symmetry netloc rmax ranking rebuilding learning train
freedom unmodified permitted powers inheritance dispatch descriptions conflicts simpler walks forwarded cancellation
locked callers exposes terminates aggregating weeks lemburg translate targets workers executors linked released
identifies sharing archives seems relatively opcodes said belong pick expose variants presentation situations dots
impossible uid configurations revision connecting kinds setuptools flavor complement severity symlink offers profiling
fractions dedicated versus approximately extraction conforms randomly equivalence cartesian orders google pycon draws
solve linalg einsum conjugate trimming chooses exponentially statistic smoothing outfile recall rabbit renderables
increases pure detection microsecond fold triple efficiency simplest equally operating controlling legal management
typical prompts tell dest consumes lookups clock acquired prepared programs continues listening conflict bytestring
leftmost transparent prepend existence quoting spam tail redirects defects involved underscores coerced bitmap unix
rejected risk tkinter plane modern effectively receiver pruned workaround nature mutated scan guard combines
concatenating cover dealing discovery individually slower criteria zoneinfo verification predicted learn accumulator
centers poly wheels cython bfill explode resampled elapsed ticks certificates regularization lama exhausted frozenset
popped listing updating writeable hit incremental visibility tracking opposed restored initially why eventually exited
consumer propagating stdin pieces tracing instruction fullname iter suppressed com aka marking ext stripping covered
overview five nulls audio functional incoming reach persistent standalone git skipping limitation submodules
permissions development metaclasses asked placeholder exceed literally trusted scanned indirect unpacking binds
anymore collects homogeneous styling auto projection pinned casts underline allocation recarray curve estimates orient
cloud tiger plotted bandwidth demonstrating ever diagnostic contexts magnitude closer bounded declare clients huge
quotient stuff prepare exiting leap operates incorrectly maxsize interaction former helpers pyc numbered repetitions
exporting measure redirected reconstruct predicates coercion adapted alter solely mro reliable pushed thereof braces
fashion summarized scenarios timeouts additionally seem separating topic pickles cut funcs div shifting denote
explained chaining behind born subscripts unordered triangular express mocks central nodeid quantity truthy wall stay
pruning eval choosing groupings ret clip estimators usecols rcond pseudo opset nopython listlike ffill rating italic
templates rectangular msgpack annotate encryption pen lies exp denotes multiline delegate initializing pydoc came
managing uniformly backslashes maybe servers closes super slash security home preceded afterwards little rewrite junk
treats pprint deletion folding phrase understand skips specifically exports rational saves overall distinguish
transaction proposed activated fetched importable compress stacking replacements reproduce benefit peps desc assigning
contrast unequal cased outermost limitations pareto divided preserving runtest interpolated validates demo factors
weekly nanosecond structs narrowed watermark backtick deserialized health derivatives casted horizontally analyzed
thresholds ydeg quantizes optimizer nogil backfill tokval reindex urls distributor deque pser universal environments
subclassed strftime reduces opener imply reaches movement helpful ast modifications yourself indirectly blocked
manages allocate consumers drops gathered expired maintained pages malformed texts launch continuation initializes
legend verified mimic ascii folded textual denominator supplying urllib sublist enter coming destroyed viewer coverage
preferences curly validity capable machinery ipaddress exceeded portions lexical modifies invocations detects achieved
denoted sigma tracks patches traversal verifying comparable aligns api confidence pytz natively interoperability
datatypes titles preprocessor triplet statistical ensemble tabular toy person pools cloudpickle plans trained
installing derive quiet subnormal scientific greatest emits directive longest occurring visitor resets logs notified
retrieves established scales superclass compilation communication substitutions held complicated arbitrarily examine
ellipsis semantically surrounding mail lets maintains enforced deleting ordinals ensuring unable idlelib fed
substitute loads restart icon forming uninitialized accesses discovered busy determination lifetime wildcard timing
renders star reflection quality lot developers escaping regarding analyze finalizers suggested resolves caution
refused datasource technique shrinker reorder masking varying itemsize reshaped business argsort reshaping orientation
algebra whitespaces unintuitive cores sdist interpolate isna reindexed sparsify pearson virtualenv httpbin batching
checkpointed descendants abs subtraction sin efficiently commas goal worth bracket margin think trivial decision timed
futures unnecessary upstream exposing filesystems debugged says extremely composed situation querying filepath
keybindings submodule doctests outcome promotion defect cleaning somewhat appeared simplified pop guessed picklable
hashlib invariant protected disks reply popup browsers clicked configurable interest geometry editable alphanumeric
closure opt unbound edition externally scanner overwrites memoryview packing dividing expansion abbreviations renaming
concept translates disallowed stride gamma nicer rmtree artifacts pyproject frequently transformers logically subquery
inlined capsule inferring atomic profiles backends fragments reductions increment squeezed flip memmap downloads
outline probabilities measurement paper estimation der principal fig gain fusion llama predict categoricals elk
multiples toknum nrows animals sheets asof decay alert pie scatter xticks hasher question absent vars multiply
dividend aspects ceiling increased opens intent mixin datagram joining handshake policies completes primitives
interrupted returncode termination decides stopping startup official decodes causing stale presented substitution
inserts manipulation author instructions accumulate merges atom rewritten requesting savings specially trust reject
parenthesis pane recreate boxes interact tooltips tagged noise recording temp retrieving moves interactively
significantly layouts mathematical penguin play structural mutually correctness formula selectors rebuild ivar
collectors duckdb collation carries aggregates polars ceil identically infers deserialize endianness principle subok
typedef rtol analogous unstacked freqs net divisible skew skiprows logistic cpu hood workbook con jitted refs sender
cloned udf shutil dataflow customization internals conforming seek translation eggs people boldface encapsulates
emulate matters possibility engines mimics descendant visit traversing unlimited finishes clears transmission notion
shut recently chance knows eager pointed sleep registers subscription basics centered greedy classic late writers
posix enhanced blanks apart extracting reachable allowable linesep subsequently immediate pixmap treatment mtime
simplify fills lacks despite transitions difficult preparation fonts robust pressing hover shim recognised statically
mentioned loggers notable ability gaps satisfying conflicting roundtrip strongly stands aliased assigns approximated
discussed succeeded restricted card discouraged unescaped extending appends counterpart excinfo surprising util
highlighter persist ahead obtaining parallelism inspected deduplication multi fuzzy exclusion kurtosis folds joins
dark innermost shrinks integrated respected reducing mixture dataframes punctuation epsilon reordered locales dims
roll accounting atol ifndef hist eigenvalue pol lifespan blockwise fused pretrained numexpr bee stylesheet reindexing
prop unsafe restarts scaler nullability turtles scanning echo deferred besides traditional closely capabilities course
intention unambiguous contextmanager assumption concurrently sequentially respects launched funcname nonempty owns
deeply entering remember meets endian synonyms worst popular contrary losslessly contextual vice versa octets
terminals syntactic daylight lose stat obvious calculates wildcards slowest devices fairly effort lowercased anyway
explain htest toplevel toggle whichever queried criterion finders impact narrow considers recurse readers locate
channels ratios powerful alongside unhandled confusion hello searches subtypes inequality invariants optimizations
capitalized carry introduce flexibility narrower sized wider green captures discussion light localns mirrors tip
untouched unlikely layers binder shaped projects alphabetically varint inject printer novel replay listeners scores
discards overloads signifies subarray associative resized weekmask inaccurate doi repo integrating cube ndtype
residual cuda contrib glibc rkey performant notna utc latex alternately correlations legs multiindex price analyzing
online ewm joe permit ttype tokentype typechecker allocations tokenizers mydf unrelated readonly interested altered
unaltered maintaining curses waits superset reasonably dirty regexes shortest affecting inspecting walk collapse
idempotent proceeds manual putting producer flushed flushing disabling predefined completions deals pow extent
quotechar variations foreign linking developed extracts suffixed corners click globs interacting basename unquoted
basically knowledge discover bodies maxlinelen abstraction compliance bunch technically enumeration grow presents
unrecognized belonging reload expecting wishes specialised themes keybinding clearing buttons visual activate pressed
entities argv considerably inspection varargs chains duck equivalents existed unpickled tracked promote disclaimer
lack referring killed grab rid distinction vendor spent pager nicely inst overlaps repetition identities outcomes
excludes generics tutorial encounters rewriting ownership constructors mismatched ini installs warned matcher wrote
globalns dayfirst clocks zipped substr solid serializes alternatively vendored suppose solver bear proportion
lexicographic collisions decorate semantic astype upcast broadcastable demonstrates world namely unstable sorter conv
prepending unstack contributes deficient deprecate macros spectrum ldots averaged bounding windowing aims weighting
orthogonal autodetected relying dim mismatches checkpoints fillna styled spider upsampling forbid whiskers subplot
roaming pictures abbreviating guides temperature ciphers encrypted daemon serializers assembly eva lit mandatory
opaque informational infinities fixes inverted removal substituted retrieval tricky abbreviated involving mechanisms
classmethods highly retains crash dumped wanted nonlocal establish incremented resume asynchronously awaited suspended
overlapped enters decoders introspect yes manipulate unified eliminating confusing ran suites rarely collapsed
quotation obsolete subparts advantage interprets normalizes opts prepends promoted consequence advance entity
unmatched hiding requiring indents clicking picked absolutely templating serve paren patched bypassed numbering
loaders favor specs desirable mutation adapters precedes normalizing packet subdirectory mimetypes slashes
heterogeneous dirs unaffected measures pull tokenize heavily enforces responsibility carefully understood inversion
selections mutating verbatim conftests argname deselected denoting paste subtest encouraged accessors deduced
yearfirst weekdays monospace deserialization treating authors dead planning bisecting timedeltas tensordot generalized
subarrays reconstructed ideal numarray squeeze cumsum correction timeit polymul fillchar subroutine fftshift isnan
parity spline ham prod albeit quadrature ranked subgraphs recompute scenario midpoint standardized unmapped lkey stata
groupers bat alligator quartiles href configs retried shebang music doctype reentrant trick sibling scripting grey
reducer checkpointing iterators contribute underflow rounds rotated unnecessarily endings detached translating ease
somewhere introduces programmatically scheduling lambdas sock procedure successive proceed initialised paired amounts
ideally reraise adapt maximal oldest monitor exclusively compresslevel resp adhere compiles weakref intrinsic
historical octal deltas quadratic separation inclusion friendly subtree unstructured standards serves van pertaining
reflects hyphen differentiation amt truly worse commutative threaded permissible notification pyshell intentional
invisible mainloop repeating dirname additions transient straightforward replicate triggers hinting alternatives
nearly reaching cleaned irrelevant identification unconditionally importer mangled slotted syntactically excess arise
hides relations absence caveats ancestor reversing forbidden associate pluggy shares budget mirror stays discarding
phases holder consecutively spread workflow man geometric qualifier nondeterministic polar enums services disallow
easiest minimizes shrunk rare fuzzing variability minimize artifact upload downloading persists codepoints regions
mantissa conditionally troubleshooting ravel resize accumulation iterative traces solutions dispatches tup outliers
equations installations vec growth synthetic resides expert beam logits recommendation aggfunc myself datelike
coercing localize orc zoo extrapolate snake involves abcde halflife fsspec parallelize figsize yanked signing videos
ansi httplib vim executions udtf multiclass nominal flows synchronous planned fourth lzma sysconfig east consult signs
capability violated restores subtracting heuristic whence seekable omitting advancing seeking paging editing
manipulated strong locks someone periodic owned incrementing trip duplex improvement inappropriate scheduler addr race
processors redirecting referencing subtle dialects examined dunder clone possibilities intuitive fancy inconsistent
hack manipulating canonicalized surrogateescaped envelope dashes portable bundled circumstances toward blocksize
localization plural essential pops accelerate tunnel normalised respond configuring tracker maintenance scroll enhance
throughout modifier offending patchlevel frameworks organized variation triggering getattr aliasing carrying emitting
pasted attaches interspersed comprehensive rep undone onerror reordering methodname clipped precisely inheriting
overloaded subsets unhashable happened ambiguity concise touch summarize wild traverse migration scoped placing
substituting explanations needing snapshot hyphens injected teardowns reside parametrize redundant thin pickleable
transparently lives contract differentiated localized temporal skewness verb decided backticks getitem lax
mydescriptor hypofuzz great django prescribed targeted branches conservative downstream idna ipython accumulations
reproducible throwing sticky computational lexsort uint generalization allclose typecode typevars unscaled unitary
resample tends solves counterclockwise cov visualization distances histograms likelihood erroneous preprocessing
unsquared contributions tol baseline projected maxpower concern vander poorly multinomial ultimately latency concat
dictates labeling lexsorted arraylike enumerated agg analogue boxed setitem daily pig tok materialized koala kids
panel horse preamble multirow consideration subframe checksum itr inches manifest formulation desktop pooled
redirection covariant filetuple battery discriminated logfire validations colorful classifier presumably redefine suit
ought archs subtract derives badly stricter mixing rotation tie friends closefd distinguishes unusable divmod turning
unbuffered contributors strptime bufsize wake syscall preexisting expire unify schedule synchronization decrement
formerly life accidentally equivalently handy obey completing familiar confuse acquire resumes diagram multiprocessing
demand deeper pushes escapechar wins interior diffs anchors originating dis behaviors intact unusual grained
faithfully unparsable insofar understands rejects uniqueness numerator tty sensitivity walking successor exec shot
digests secure positioned scrolled destroy modifiers concerned abort restarting interactions menus continuously press
linecache unregister expectation offer accommodate promise zeroes eliminate couple streamed stamp periodically preset
subpath optparse snippet consuming overwriting gid unfortunately pickler accurately subscripted annotating deletions
assembled conventional illustrate told unpredictable offered oct clashes decisions unnamed parameterized invert
binomial silence delegated increments hole approx facilitate agree assertions worked stacklevel blob interrupt
monkeypatch avoiding encourage expresses usages fingerprint testsetup rebuilt millisecond lag positionally arrives
reloaded renderings factorial skewed instants chart secondary benchmarking scratch materializing pin wikipedia
grammars backs evicted covering straight lowering reproducibility polyfit asarray summing descriptive subtracted
rsplit searchsorted advisable thanks argmax neutral alleviate flattens solving meshgrid currentmodule irfft securely
vals interpolating theta tall spurious food monic reciprocal opsets onnxrt mse fake snap foldable saturation diffusion
primes pytorch sits influences exclusions categorize longtable authenticate brand melt kendall spearman prices
placement temperatures skipfooter hyperlinks uri fontsize colored isolated tarfile rewind vertices cipher multicall
isup mtu boot polymorphic publication boosting theoretical dstream argtypes sync losing silent switched indication
truncates merely stick feeding indeed lang staticmethods staticmethod readability onwards rewrites locking decremented
reliably finalizes everywhere concatenates terminating party catching deadline bidirectional subprocesses proc
facility originate dispatched undocumented synonym recover earliest eol getter recreated probable prototype backup
occupied subsequence jumps disassembly precede unwrap lots deviations practical unquoting differentiate violation
verifies imposed unquote provisional stamps safety prime involve miss anonymous pathnames cyclic topological bypass
grows expires deliberately intentionally explaining delegates editors supplies scrollable scrollbar foobar atexit
viewing confirmation mention deadlock protect resolvers sole unwrapping lightweight collapsing functionally ended
encoders forth fork deemed placeholders critical peer capacity asks driven mount syntaxes underlined confused anchored
ancestors encounter unpickler prefetch granted greeting surrogate regenerate production frozensets restrict motivation
negation finalization illustration flavors declaring illustrates advised predictable fault ternary unreachable scans
locating purge maxsplit designated strips entrypoints respecting ourselves dumps theory toml happening dumping shadow
expands mocking routed mocked iteratively bootstrapping instant quantities encountering preferable sugar setter
chardet exceeding refuses valued unioned exprs tiny therein runtimes costly arbitary targeting suppressing fixing
maximize noting machines gone smarter libcst timsort relaxed demonstrate precisions lifecycle connects optimisation
stackoverflow overflows hopefully observability correlated minimizing independence difficulty lossless clarify
adjustments memoize forwards licensed ndmin laid marginally stability algebraic outputting alphabetic argmin amax amin
suggest diag simulate mkdtemp hstack vstack zeroth wherever truthful cdot ogrid intp likes isin meaningless medians
estimating fulfill inds gaussian isfinite interpreting univariate quo unmanageable differentiating zdeg neglected
instability leg builders fuse fusions quant submodel inferencing guidance effectiveness graphs sentences embeddings
longformer sudo timesteps adopts prerequisite abstracts autodetect tick linux iloc chunking removals issuing caps
publish objs quetzal exploding speeds populations borders sharex sharey quartile rot colours quantitative bootstrap
intends tokenstring bright thinks somehow vertex palette initiated advice observe pushdown fruit trait centroid
objective materialize lor penalty sortedcontainers became undetermined associating makefile architectures compilers
west capitals defers counterparts pipes simultaneous flushes coding trouble sums tightly fieldname mind transmit
serving aborting aborted noticeable nbytes arranges newest beforehand cancels submitted decreases suspend activity
freed pads deletes directs interpreters remembers computations itertools doublequote lineterminator affinity abi libc
restoring dumb umask published fundamental catches vulnerable likewise meanings adaptive summaries alternating brief
parens mime outright incrementally surrogates room uninstallation becoming fileinput lookahead boilerplate delegating
hits computer clearly annoying tunnelling synchronously recognizes signify reconstituted edited browse editwin
successively aid keyboard eight textview families permanently scrolling titlecase searchengine worthwhile dragging
unsuccessful seeing modal notify owning linenumber injection adjustment enumerates infos unwrapped deduplicated
sortable subnet differing simplejson mydict forked areas rotate rotating switches refactoring regarded mounted
materials leftover resemble totally incorporated leak embed sanity hereby unorderable superclasses creator amp lie
unfilled decorating appearing improperly relationships hashed resembles repair exceptional mutability emulates
explored specialization distinctions excepting stated canceled finalized speaking permutation secrets toolkit cleaner
errno oriented entrypoint mistake colons codebase progresses prepares pyvenv indirection overly ported isolation
snippets negated quick led compose tzdata separates invalidate blog entropy notebooks declares amongst earnings signum
deducted macro ephemeral simplicity hashtable trade majority clash tooling replayed fetching inefficient guessing
claims exploring substantially corpus decrementing regenerated restrictive asanyarray ascontiguousarray asfortranarray
classical forcing permuted propagation ary tolist putmask ages clipping cumprod progression dstack binning viewed
adjusts mgrid coercible capitalize deletechars considerations lexicographical upgraded multiplying avg graphically
nans characteristic conditioned splines hexbin multithreaded environmental auxiliary overdetermined problematic feeds
gpu symmetrically smooth bert strength abis rankings exploded fastpath preferably nunique influence duplicating
contribution ostrich toprule city unpivot cli revised intelligently installable agent peers retrying posting
opinionated fair groff javascript linewise colour paint lex undesirable statuses unreserved backtracking truecolor
refreshes preloaded retryable urlparse sout decrease columnar middleware assembler underlining predictor maximized
minimized sklearn contingency sfun reattachable stretched okay feasible limiting ten convergence strictness
unformatted ultimate freely asking sane metavar nargs unambiguously multiplexer looping shuts internet queued gotten
preventing spawn gather eagerly interfere emulated miscellaneous sophisticated recursing severe deepcopy assist
occasionally loose tend volatile measuring cubic entirety claim accidental craft worry tabsize traced insufficient
considerable splice continuing recovery atoms squeezing replicates flattening rough retaining specializations settable
uninstall reassign directed login improves predecessor collision sake simulation clever transmitted curl comply
downgrade extensible comp violate spanning augment quit populates shortcuts tabwidth gradually messagebox facilities
dedent brought traversed visited unwanted importers experiments packaged intermediary justification traversable
sensible manipulates quad colno suggestion delivery keyfile intensive tuning datastore reimplementation fetches
endorse impose launching exclamation restarted honored delivered realize stating draft unlock took his commented swaps
expressing perfectly clarity decrements protection relied spelled delegation conformance altogether customizing
bypassing harder containment programmers reverses randomness reproducing fullmatch exhaustive renames recurses million
slowdown replicating actively isinstance optname positives commandline introspected visually yellow patching perfect
isolate parametrizations totals interacts workarounds leaked discretion locs forgotten composes freeze vanilla certifi
prioritize migrate gettz erroneously hourly improving opportunity annual brings permanent summer dayofweek siblings
began gave detecting unpinned asc jsonlines durations quirks proactively propagates unsound suppression refuse flatmap
fatal intercepts analyse benefits flaky finfo adapts intend hope downside incorporate missed explore representative
balance shuffled understanding complain spit integrates replicated permutations supersedes fromfunction imag flatiter
longdouble expense pyfunc conserve versioning relates speedup empirical vsplit matmul copyto convolve flips inadequate
subpackage slen introduction shifts utils intersect discriminate piecewise consequently accounts binned flagged
hypothetical inherently cuts empirically batched moduleauthor contact law rearrange dequantize softmax unsatisfiable
finalize spell rdivmod cummin cummax kurt comprise speedups accommodates dollar ant defaultdict spreadsheet conformed
proportions startrow startcol bottommost complevel complib compressors searchable committed pasting midrule bottomrule
frac asfreq dispersion facing aforementioned disambiguate exchange concepts perspective indicators mass urlopen panes
depicting circles comprises article visualize gracefully editables charge sublicense sell persons whom furnished
substantial serial asserted blinking lightbg darkbg colorscheme consistently contributing bgcolor capath
simplifications scenes nonamefile disappeared mitigate modeling papers subsystem inheritable cogrouped descent scala
cardinality scol deployment qname decreased selectively terminator forever presses sound informative informs queues
unblock factories enqueued cancelling instantiates attaching notifications trap administrative encapsulate reraised
dealt stateless frontend aim continuations sans expansions transferring letting shareable availability expectations
thumb omits variety intervening obscure pointless clarification deviate unfolded unparsed carriage linefeed
internationalized prohibited rooted adaptation zlib junction strange balancing constrains origins semicolons semicolon
attacks toggled backgrounds face aspect unclear mixes backported openers constrained distributors hang delayed
presumed imagine paradigm apparent crashes examining seven fundamentally partly shortened thereto carried consulting
proxied remembered reopened refactored deliver enqueue manipulations overflowing continually cleans executables stand
resuming unconditional directions parseable suffer excellent deallocated multiplicative mathematics orderings tighter
modeled illustrated noted tricks uppercased abuse unicodedata artificial eliminated recipe seeding complementing
behalf misleading costs evolve descended communicating unboxing corrected enormous lexically whilst basenames
conveniently readily setups subgroups erased deterministically poor customise buggy superior gotchas mutations accents
assistant uncommon broader widen widening parenthesised translator dayofyear relational labelled motivated unresolved
feel doubled handed untyped alphabets logarithms configures bring refactor tens integrations feedback approaches
randomized obviously upgrading assumptions constrain seamlessly minimises boring arising branching computationally
book borrowed subtrees duplication lowered prone unfortunate introducing research nil biased sphinx spelt liberal
safer getfield tofile swapping umath swapcase tile optimizes footprint multiarray hsplit overloading perpendicular
preview sufficiently extern ifftshift remotely stringified averaging peak fulfills insertions coords corrupt leaking
presently unreliable uncertainty composition customary typeset factorized rand smoothness nix allowlists quantizing
producers arxiv mid clearer precomputed wholesale hot asserting dash pivoting releasing geographic pointwise coded
divisions interrogate designates intercalary noon consensus casing mutates telling tokenization multicolumns numerics
granularity unintended interrogating datetimetz encompasses thresh corr clines fictional tendency endowed maxima
elegant unstacker regard massage malicious prettify strlen graphical instruct reflecting longitude latitude
multivariate subcommand environ netrc pulled beneath tempdir warns pooling filetype prevented pypy agreed board
testcase lexing autoclass investigation reapplies backtrack crop cropping stretch est dec unconstrained
indiscriminately ponies totality counterintuitive unsubscripted synthesize passwords tunneling counters hexdigits
outgoing hookwrapper disappears role crate shorten pragmas academic classified parallelized contributor licenses
outputted multiplier rescaled predicting diffed lateral infile miscellany dialogs turtledemo minidom beautiful morning
evening afternoon tonight yesterday tomorrow customer customers government countries woman women school student
students teacher university market company companies money industry hospital doctor patient medicine science culture
society political president election minister police court lawyer military economy economic financial bank insurance
investment energy water weather winter mountain river ocean forest garden kitchen bedroom bathroom breakfast dinner
restaurant coffee chocolate chicken vegetable vegetables flower flowers elephant birthday christmas holiday vacation
travel airport hotel vehicle bicycle football baseball basketball player players season champion championship musician
guitar concert movie television newspaper magazine journalist photograph picture painting artist wonderful fantastic
amazing incredible terrible dangerous comfortable delicious favorite favourite husband brother sister daughter mother
father grandmother grandfather friend friendship neighbor neighbour marriage wedding community everyone everybody
somebody forgot believe thinking answered certainly definitely suddenly slowly kingdom castle soldier justice peaceful
religion christian church english french german spanish italian american british european chinese japanese russian
confidential compromised
""".split()
