"""Fixed values of the code analysis: names of web, database and file libraries and patterns over source text.

They decide which lines are reported, so they are whole and as they have to be; the rules that use them are in `code`.
"""

# Calls that run SQL, wrappers of SQL text, and what SQL text looks like.
SQL_METHODS = "execute executemany executescript raw extra execute_sql fetch fetchrow fetchval fetch_all fetch_one query".split()
SQL_WRAPPERS = "text SQL RawSQL TextClause".split()
SQL_WORDS = r"(?i)\b(select|insert\s+into|update|delete\s+from|where|order\s+by|union|like)\b|\w+\s*=\s*'?\s*$|=\s*'?\s*%s|=\s*'?\{"
NOSQL_METHODS = "find find_one find_one_and_update find_one_and_delete delete_one delete_many update_one update_many count_documents aggregate".split()
NOSQL_HINT = r"(?i)mongo|pymongo|motor|collection|\.db\b|bson"

# Calls that touch files.
FILE_FUNCTIONS = "open file send_file FileResponse remove unlink rmtree copyfile copy move listdir StreamingResponse static_file".split()
PATH_METHODS = "read_text read_bytes write_text write_bytes open unlink save iterdir".split()
FILE_MODULES = "os shutil io codecs path".split()
READS_OR_WRITES = "open read_text write_text read_bytes write_bytes".split()
FILE_PARAMETER = r"(?i)file_?name|\bfname\b|\bfile_?path\b|^path$|^file$"
PATH_PARTS = "name stem suffix id pk".split()

# Where values come from, what cleans them and what passes them on.
REQUEST_WORDS = r"(?i)request|\breq\b|query|param|\bargs?\b|argument|form|body|cookie|header|environ|payload|\bjson\b|\bPOST\b|\bGET\b|\bFILES\b|\binput\b|match_info|\burl\b|\buri\b"
CONFIGURATION = r"os\.environ|getenv|settings\.|config\.|app\.config|__file__"
LOOKUP = (
    r"\.(?:query|filter|filter_by|execute|scalar|scalars|first|one|one_or_none|fetchone|fetchall|fetchrow|find_one|get_or_404|first_or_404)\(|"
    r"\.objects\.|get_object_or_404\(|select\(|(?:db|session|conn|cursor|cur)\.\w+\("
)
NO_PARAMETERS = "self cls args kwargs options db session conn cursor".split()
CLEANERS = "secure_filename basename int float bool len uuid4 token_hex token_urlsafe hexdigest safe_join quote_ident isoformat strftime slugify".split()
CARRIERS = (
    "join joinpath Path PurePath PosixPath str bytes format strip lstrip rstrip lower upper replace unquote unquote_plus loads decode encode get pop split rsplit abspath normpath "
    "realpath resolve dirname expanduser dict list tuple getattr b64decode urlparse parse_qs read items values keys title capitalize with_suffix with_name relpath fspath copy setdefault"
).split()
VERB_METHODS = "get post put patch delete head do_GET do_POST do_PUT do_DELETE".split()
NO_REQUEST_FILE = r"/(management/commands|migrations|scripts?|fixtures|seeds?)/|/(seed\w*|populate\w*|manage|setup|conftest|settings\w*|config\w*|wsgi|asgi)\.py$"

# Controls before a sink.
STRONG_PATH = (
    r"commonpath\(|\.is_relative_to\(|\.relative_to\(|secure_filename\(|safe_join\(|send_from_directory\(|os\.path\.basename\(|\bbasename\(|"
    r"\.resolve\(\)\.parent\s*[!=]=|\.startswith\([^)\n]*(?:os\.sep|sep\b|[\"']/[\"'])"
)
WEAK_PATH = r"\.startswith\(|[\"']\.\.[\"']\s+(?:not\s+)?in\b|\.replace\(\s*[\"']\.\.|normpath\(|\.lstrip\(\s*[\"'][./\\]+[\"']"
STRONG_SQL = r"sql\.Identifier\(|sql\.Literal\(|sql\.Placeholder\(|quote_ident\(|quote_name\(|\.isidentifier\(\)|bindparam\(|sqlalchemy\.sql\.expression"
MAX_SEEDS = 60
SAME_PLACE = 15

# Columns and tables of ownership.
OWNER_COLUMN = (
    r"^(owner|user|author|creator|created_by|account|customer|tenant|org|organization|member|borrower|buyer|seller|doctor|patient|landlord|tenant_user|assignee|uploader|requester)(_id|_uuid)?$"
)
USER_TABLE = r"(?i)^(user|users|account|accounts|member|members|customer|customers|app_user|appuser)$"
PASSWORD_COLUMN = r"(?i)^(password|password_hash|hashed_password|passwd|pw_hash)$"
PERSONAL_COLUMN = r"(?i)^(phone|phone_number|address|email|ssn|dob|date_of_birth|salary|iban|card_number|passport)$"
KEY_CALLS = "ForeignKey OneToOneField".split()
RELATION_CALLS = "relationship ManyToManyField".split()
MODEL_BASE = r"(?m)Model$|AbstractUser|AbstractBaseUser"
USER_BASE = r"AbstractUser|AbstractBaseUser"
USER_KEY = r"\bAUTH_USER_MODEL$|\bget_user_model\("
COLUMN_CALLS = "Column mapped_column Field relationship".split()

# Routes, sign-in, roles and owners.
ROUTE_CALLS = "route get post put patch delete api_route".split()
ID_PARAMETER = r"(?i)(id$|_uuid$|^pk$|^slug$)"
CURRENT_USER = r"current_user|get_current_user|session\s*\[\s*['\"](uid|user_id|user)['\"]\s*\]|session\.get\(\s*['\"](uid|user_id|user)|g\.user|request\.user|current_user_id\(\)|auth_user|user\.id\b|me\.id\b"
DECORATOR_OWNER = r"owner|\.user_id|user_id\s*!=|!=\s*current_user"
ROLE_WORDS = r"(?i)admin|role|permission|is_staff|is_superuser|has_role|require_role|superuser"
LOGIN_WORDS = r"(?i)login_required|jwt_required|auth_required|authenticated|get_current_user|current_active_user|require_login|token_required"
BODY_LOGIN = (
    r"session\.get\(\s*['\"](logged_in|user_id|uid|user)['\"]|session\[\s*['\"](logged_in|user_id|uid|user)['\"]\s*\]|current_user_id\(\)|current_user\.is_authenticated|abort\(\s*401|"
    r"verify_token|decode_token|jwt\.decode|get_current_user\(|token_required|login_required"
)
REQUEST_OWNER = r"(request\.(args|form|json|values|query_params)|\bdata|\bpayload|\bbody|get_json\(\))[^\n]*['\"](user_id|owner_id|uid|account_id|customer_id|userId|ownerId)['\"]"
USER_ID = r"(current_user\.id|current_user\b|(?:self\.)?request\.user(?:\.id|\.pk)?\b|user\.id|g\.user(\.id)?|me\.id|uid\b|session\s*\[\s*['\"]\w+['\"]\s*\]|session\.get\([^)]*\)|current_user_id\(\))"
ACCESS_HELPER = r"is_member\(|has_access\(|can_(view|edit|access)\(|authorize\(|check_owner|ensure_owner"
USER_TOKEN = r"\b(user|actor|current_user|principal|me|viewer|requester|request)\b"
OWNER_COMPARED = (
    r"\.\w+_id\b\s*(?:[=!]=|not\s+in\b|in\b)|[=!]=\s*[\w.]+\.\w+_id\b|\.(?:owner|user|author|creator|created_by)\b\s*[=!]=|[=!]=\s*[\w.]+\.(?:owner|user|author)\b|"
    r"(?:filter|filter_by|where|get|get_object_or_404|exclude)\([^\n]*\b\w+_id\s*=\s*(?:self\.)?(?:request\.user|current_user|user|actor)\b"
)
OWNER_QUERY = r"(?:filter|filter_by|where|get|get_object_or_404|exclude)\([^\n]*\b"
ROLE_CHECK = r"(?i)\.role\b|\brole\s*(?:[=!]=|in\b|not\s+in\b)|is_admin|is_staff|is_superuser|has_role|require_role|has_perm|is_manager|\bpermissions?\b|\bscopes?\b"
LOGIN_CHECK = r"(?i)HTTP_401|status_code\s*=\s*401|abort\(\s*401|jwt\.decode|decode_token|verify_token|oauth2_scheme|get_current_user|credentials|Unauthorized|api_key|x-api-key|is_authenticated|session\.get\(|session\["
DENIES = r"(?i)raise\s|abort\(|return\s+False|return\s+None|HTTP_40[134]|40[134]\b|Forbidden|PermissionDenied"
GATE = r"status_code\s*=\s*(?:status\.)?(?:HTTP_)?40[13]|HTTPException\(\s*40[13]|abort\(\s*40[13]|PermissionDenied|Forbidden\(|Unauthorized\("
CREDENTIAL_WORDS = r"(?i)headers|cookies|token|secret|key"
CREDENTIAL_COMPARED = r"(?i)(?:headers|cookies|META)\b[^\n]*(?:[=!]=|compare_digest)|compare_digest\([^\n]*(?:headers|cookies|META|token|key)"
USER_PARAMETER = r"(?i)user|actor|principal|staff|admin|member|account|viewer|current"
ADMIN_ONLY = r"(?i)admin|superuser|is_staff\b"
WRITES = r"(?i)\.delete\(|session\.delete|DELETE\s+FROM|UPDATE\s+\w+\s+SET|\.commit\(\)|setattr\("
PUBLIC = r"(?i)login|logout|register|signup|sign_up|index|^home$|health|static|about|forgot|reset|token|public|favicon|docs|openapi|^root$|status|ping|version"
DANGEROUS = r"(?i)\beval\(|\bexec\(|subprocess\.|os\.system\(|os\.popen\(|render_template_string\(|etree\.|xml\.dom|pickle\.loads|yaml\.load\(|drop_all\(|DROP\s+TABLE"
SENSITIVE = r"(?i)\.delete\(|DELETE\s+FROM|UPDATE\s+\w+\s+SET|INSERT\s+INTO|\.commit\(\)|subprocess|os\.system|eval\(|exec\(|open\(|send_file|admin|password|secret|token"

# Views of Django and its REST framework.
NO_VIEW_FILE = r"(urls|models|admin|settings|serializers|forms|apps|permissions)\.py$|/migrations/|/management/"
URL_CALLS = "path re_path url register".split()
VIEW_BASE = r"View$|ViewSet$|APIView$|Mixin$|^generics\.|^viewsets\.|^views\."
DETAIL_BASE = r"ModelViewSet|ReadOnlyModelViewSet|Retrieve|Update|Destroy|DetailView|UpdateView|DeleteView|GenericViewSet"
WRITE_BASE = r"ModelViewSet|Create|Update|Destroy|DeleteView|CreateView|UpdateView|FormView"
VIEW_VERBS = "get post put patch delete".split()
VIEW_LOGIN = r"login_required|LoginRequiredMixin|IsAuthenticated\b|authentication_required|TokenHasScope|IsAuthenticatedOrReadOnly"
VIEW_ROLE = (
    r"permission_required|user_passes_test|staff_member_required|PermissionRequiredMixin|UserPassesTestMixin|IsAdminUser|DjangoModelPermissions|superuser|[Aa]dmin|[Ss]taff|"
    r"[Mm]anager|[Rr]ole"
)
VIEW_WRITES = r"\.save\(|\.delete\(|\.update\(|\.create\(|\.bulk_create\(|\.set\(|\.add\(|\.remove\("
VIEW_SCOPED = (
    r"\w+\s*=\s*(?:self\.)?request\.user\b|(?:self\.)?request\.user\.\w+\.(?:all|filter|get|exclude)\(|(?:self\.)?request\.user\.\w+_set\b|"
    r"[=!]=\s*(?:self\.)?request\.user\b|(?:self\.)?request\.user\s*[=!]=|(?:self\.)?request\.user\.(?:id|pk)\b\s*[=!]=|[=!]=\s*(?:self\.)?request\.user\.(?:id|pk)\b"
)
VIEW_LOGIN_BODY = r"request\.user\.is_authenticated|request\.user\.is_anonymous|request\.auth\b"
VIEW_ROLE_BODY = r"request\.user\.(is_staff|is_superuser|has_perm|groups|role)\b|\.has_perm\("
VIEW_REFUSES = r"raise|Forbidden|redirect\(|return\s+Response\(|PermissionDenied|40[13]|return\s+(self\.)?request"
