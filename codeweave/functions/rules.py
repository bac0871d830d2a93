"""The security rules as a table for ``operators.text.rule_scan``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, category, severity, extensions (empty: all), pattern, exclusion.
_WEB = "py js ts java go rb php cs rs"
SECURITY = (
    ("SEC001", "SqlInjection", "High", _WEB, "execute(", "# nosec"),
    ("SEC002", "SqlInjection", "High", _WEB, "raw_query(", ""),
    ("SEC003", "SqlInjection", "Critical", "py js ts java go rb php cs", 'format!("select', ""),
    ("SEC004", "SqlInjection", "Critical", "py js ts java go rb php", 'f"select', ""),
    ("SEC005", "SqlInjection", "Critical", "py js ts java go rb php", "f'select", ""),
    ("SEC010", "HardcodedSecret", "Critical", "", 'password = "', "example"),
    ("SEC011", "HardcodedSecret", "Critical", "", "password = '", "example"),
    ("SEC012", "HardcodedSecret", "Critical", "", 'secret_key = "', ""),
    ("SEC013", "HardcodedSecret", "Critical", "", 'api_key = "', "os."),
    ("SEC014", "HardcodedSecret", "High", "", "aws_secret_access_key", "os.environ"),
    ("SEC015", "HardcodedSecret", "High", "py js ts go java rb cs rs", 'private_key = "', ""),
    ("SEC016", "HardcodedSecret", "High", "", "-----begin rsa private key-----", ""),
    ("SEC017", "HardcodedSecret", "High", "", "-----begin ec private key-----", ""),
    ("SEC020", "DangerousEval", "High", "py", "eval(", "#"),
    ("SEC021", "DangerousEval", "High", "js ts", "eval(", ""),
    ("SEC022", "DangerousEval", "Medium", "py", "exec(", "#"),
    ("SEC030", "InsecureDeserialization", "Critical", "py", "pickle.loads(", ""),
    ("SEC031", "InsecureDeserialization", "Critical", "py", "pickle.load(", ""),
    ("SEC032", "InsecureDeserialization", "High", "py", "yaml.load(", "loader=yaml.SafeLoader"),
    ("SEC033", "InsecureDeserialization", "High", "java", "objectinputstream", ""),
    ("SEC034", "InsecureDeserialization", "High", "rb", "marshal.load(", ""),
    ("SEC040", "PathTraversal", "High", _WEB, "../", "test"),
    ("SEC041", "PathTraversal", "Medium", "py", "open(request.", ""),
    ("SEC050", "Ssrf", "High", "py", "requests.get(request.", ""),
    ("SEC051", "Ssrf", "High", "py", "requests.post(request.", ""),
    ("SEC052", "Ssrf", "Medium", "js ts", "fetch(req.", ""),
    ("SEC060", "Xxe", "High", "py", "etree.parse(", "defusedxml"),
    ("SEC061", "Xxe", "High", "java", "documentbuilderfactory.newinstance()", "setfeature"),
    ("SEC070", "WeakCrypto", "Medium", "", "md5(", "test"),
    ("SEC071", "WeakCrypto", "Medium", "", "sha1(", "test"),
    ("SEC072", "WeakCrypto", "High", "", "des(", ""),
    ("SEC073", "WeakCrypto", "Medium", "py js ts go java rb rs", "hashlib.md5(", ""),
    ("SEC080", "CommandInjection", "Critical", "py", "os.system(", ""),
    ("SEC081", "CommandInjection", "High", "py", "subprocess.call(", "shell=False"),
    ("SEC082", "CommandInjection", "High", "py", "subprocess.popen(", "shell=false"),
    ("SEC083", "CommandInjection", "High", "js ts", "exec(", "test"),
    ("SEC084", "CommandInjection", "High", "go", "exec.command(", ""),
    ("SEC090", "InsecureRandom", "Medium", "py", "random.random(", ""),
    ("SEC091", "InsecureRandom", "Medium", "py", "random.randint(", ""),
    ("SEC092", "InsecureRandom", "Medium", "js ts", "math.random()", ""),
    ("SEC100", "XssRisk", "High", "js ts", "innerhtml", ""),
    ("SEC101", "XssRisk", "High", "js ts", "dangerouslysetinnerhtml", ""),
    ("SEC102", "XssRisk", "Medium", "py", "mark_safe(", ""),
    ("SEC110", "OpenRedirect", "Medium", "py js ts go java rb", "redirect(request.", ""),
)


def security_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, c, s, e.split(), p, x) for i, c, s, e, p, x in SECURITY]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, extensions array<string>, pattern string, exclude string")
