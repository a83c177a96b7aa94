"""Condition cases: per operator a few (attribute, expected JSON, oracle SQL) (fixed values)."""

CASES: dict[str, list[tuple[str, str | None, str]]] = {
    "EQUALS": [
        ("user.department", '"HR"', "dept = 'HR'"),
        ("user.department", '"Legal"', "dept = 'Legal'"),
        ("user.role", '"Manager"', "role = 'Manager'"),
        ("user.clearanceLevel", '"3"', "FALSE"),
        ("user.clearanceLevel", "3", "clearance = 3"),
        ("user.clearanceLevel", "3.0", "FALSE"),
        ("currentTime", "3", "FALSE"),
        ("user.department", None, "FALSE"),
        ("spark.app.name", '"notebook"', "env_app = 'notebook'"),
    ],
    "NOT_EQUALS": [
        ("user.department", '"HR"', "dept IS NOT NULL AND dept <> 'HR'"),
        ("user.role", '"Manager"', "FALSE"),
        ("user.clearanceLevel", '"3"', "TRUE"),
        ("user.clearanceLevel", "3", "clearance <> 3"),
        ("user.department", None, "dept IS NOT NULL"),
    ],
    "GREATER_THAN": [
        ("user.clearanceLevel", "2", "clearance > 2"),
        ("user.clearanceLevel", '"2"', "clearance > 2"),
        ("user.clearanceLevel", "2.5", "clearance > 2.5"),
        ("user.department", "2", "FALSE"),
        ("user.role", "2", "FALSE"),
        ("user.clearanceLevel", None, "FALSE"),
    ],
    "GREATER_THAN_OR_EQUAL": [
        ("user.clearanceLevel", "3", "clearance >= 3"),
        ("currentHour", "12", "hr >= 12"),
        ("user.clearanceLevel", '"x"', "FALSE"),
        ("missing.name", "1", "FALSE"),
        ("user.clearanceLevel", None, "FALSE"),
    ],
    "LESS_THAN": [
        ("resource.sensitivityLevel", "4", "sens < 4"),
        ("currentHour", '" 12 "', "hr < 12"),
        ("user.username", "5", "FALSE"),
        ("missing.name", "1", "FALSE"),
        ("currentHour", None, "FALSE"),
    ],
    "LESS_THAN_OR_EQUAL": [
        ("resource.sensitivityLevel", '"4"', "sens <= 4"),
        ("user.clearanceLevel", "1e0", "clearance <= 1"),
        ("resource.sensitivityLevel", "[4]", "FALSE"),
        ("user.role", "9", "FALSE"),
        ("currentHour", None, "FALSE"),
    ],
    "CONTAINS": [
        ("resource", '"/finance/"', "contains(resource, '/finance/')"),
        ("user.clearanceLevel", "3", "clearance = 3"),
        ("user.role", '"a"', "role IS NOT NULL"),
        ("resource", None, "FALSE"),
        ("user.domain", '"company"', "coalesce(contains(domain, 'company'), FALSE)"),
    ],
    "NOT_CONTAINS": [
        ("resource", '"/finance/"', "NOT contains(resource, '/finance/')"),
        ("user.role", '"z"', "role IS NOT NULL"),
        ("resource", None, "FALSE"),
    ],
    "STARTS_WITH": [
        ("resource", '"s3://"', "starts_with(resource, 's3://')"),
        ("user.username", '"hr_"', "starts_with(username, 'hr_')"),
        ("resource.type", '"s"', "starts_with(resource, 's3://')"),
        ("resource", None, "FALSE"),
    ],
    "ENDS_WITH": [
        ("resource", '".parquet"', "ends_with(resource, '.parquet')"),
        ("user.domain", '".com"', "coalesce(ends_with(domain, '.com'), FALSE)"),
        ("user.role", '"r"', "role IS NOT NULL"),
        ("resource", None, "FALSE"),
    ],
    "MATCHES": [
        ("user.username", '"(hr|finance)_u[0-9]+"', "regexp_full_match(username, '(hr|finance)_u[0-9]+')"),
        ("user.username", '"hr"', "FALSE"),
        ("user.username", '"(unclosed"', "FALSE"),
        ("user.role", '".*"', "role IS NOT NULL"),
        ("user.clearanceLevel", '"[34]"', "clearance IN (3, 4)"),
        ("user.username", None, "FALSE"),
    ],
    "IN": [
        ("user.department", '["HR", "Finance"]', "dept IN ('HR', 'Finance')"),
        ("user.clearanceLevel", '[2, "3"]', "clearance = 2"),
        ("currentDay", '["SATURDAY", "SUNDAY"]', "dow IN ('SATURDAY', 'SUNDAY')"),
        ("user.department", '"HR"', "FALSE"),
        ("user.role", '["Manager"]', "role = 'Manager'"),
        ("user.department", None, "FALSE"),
    ],
    "NOT_IN": [
        ("user.department", '["HR", null]', "dept IS NOT NULL AND dept <> 'HR'"),
        ("user.clearanceLevel", '[2, "3"]', "clearance <> 2"),
        ("user.department", '"HR"', "dept IS NOT NULL"),
        ("user.role", '["Other"]', "role IS NOT NULL"),
        ("user.department", None, "dept IS NOT NULL"),
    ],
}

EXPRESSIONS: list[tuple[str, str]] = [
    ("currentHour >= 8 && currentHour <= 18", "hr BETWEEN 8 AND 18"),
    ("T(java.time.LocalTime).now().getHour() >= 8 && T(java.time.LocalTime).now().getHour() <= 18", "hr BETWEEN 8 AND 18"),
    ("user.clearanceLevel >= resource.sensitivityLevel", "clearance >= sens"),
    ("#user_department == 'HR' || #user_role == 'Manager'", "coalesce(dept = 'HR', FALSE) OR coalesce(role = 'Manager', FALSE)"),
    ("#spark_app_name == 'notebook' AND action IN ('read', 'query')", "env_app = 'notebook' AND action IN ('read', 'query')"),
    ("user_clearanceLevel / 0 > 1", "FALSE"),
    ("user_department > 5", "FALSE"),
    ("user_clearanceLevel + 1", "FALSE"),
    ("reflect('java.lang.System', 'exit', 0) = 1", "FALSE"),
    ("length(missing_name) > 0", "FALSE"),
]
