"""Paths that hold secrets, and files that are of no interest, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths and of files with secrets.
SECRET_PATHS = (
    r"(?:^|/)\.git(?:/|$)", r"(?:^|/)\.ssh(?:/|$)", r"(?:^|/)\.aws(?:/|$)", r"(?:^|/)\.docker(?:/|$)", r"(?:^|/)\.config/gcloud(?:/|$)", r"(?:^|/)\.azure(?:/|$)",
    r"(?:^|/)\.kube(?:/|$)", r"(?:^|/)\.terraform(?:/|$)", r"(?:^|/)secrets(?:/|$)", r"(?:^|/)private(?:/|$)", r"(?:^|/)\.password-store(?:/|$)",
    r"\.mozilla/firefox/", r"\.config/chromium/", r"\.config/google-chrome/", r"Library/Application Support/Google/Chrome/", r"Library/Application Support/Firefox/",
    r"Library/Keychains/", r"(?:^|/)\.thunderbird(?:/|$)", r"(?:^|/)\.evolution(?:/|$)", r"(?:^|/)\.vagrant(?:/|$)", r"(?:^|/)\.minikube(?:/|$)",
    r"(?:^|/)\.bitcoin(?:/|$)", r"(?:^|/)\.ethereum(?:/|$)", r"(?:^|/)\.electrum(?:/|$)",
)
SECRET_FILES = (
    r"\.env$", r"\.env\..+$", r"^\.npmrc$", r"^\.pypirc$", r"^\.netrc$", r"^\.dockercfg$", r"^\.docker/config\.json$", r"^credentials$", r"^\.credentials$", r"^\.aws/credentials$", r"^\.aws/config$",
    r"^\.ssh/.*$", r"^id_rsa$", r"^id_dsa$", r"^id_ecdsa$", r"^id_ed25519$", r"^id_rsa\.pub$", r"^id_dsa\.pub$", r"^id_ecdsa\.pub$", r"^id_ed25519\.pub$", r"^known_hosts$", r"^authorized_keys$",
    r".*_rsa$", r".*_dsa$", r".*_ecdsa$", r".*_ed25519$", r"^private.*\.key$", r"^private.*\.pem$", r"^.*[-_]private[-_].*\.key$", r"^.*[-_]private[-_].*\.pem$", r"[-_]private\.key$", r"[-_]private\.pem$",
    r"^.*\.private\.key$", r"^.*\.private\.pem$", r"\.pem$", r"\.key$", r"\.crt$", r"\.cer$", r"\.keystore$", r"\.p12$", r"\.pfx$", r"\.jks$", r"\.ppk$",
    r"^service[-_]account.*\.json$", r"^.*-service[-_]account.*\.json$", r"^application[-_]default[-_]credentials\.json$", r"^gcloud[-_]credentials\.json$", r"^kubeconfig$", r"^\.kube/config$", r"^k8s[-_]config$",
    r"^terraform\.tfstate$", r"^terraform\.tfstate\.backup$", r"^terraform\.tfvars$", r"^\.terraform\.lock\.hcl$", r"^\.pgpass$", r"^\.my\.cnf$", r"^\.psqlrc$", r"^secrets\.yml$", r"^master\.key$", r"^config/master\.key$",
    r"^wp-config\.php$", r"^google-services\.json$", r"^GoogleService-Info\.plist$", r"^keystore\.properties$", r"\.mobileprovision$", r"\.provisionprofile$",
    r"^\.token$", r"^token\.txt$", r"^access_token$", r"^refresh_token$", r"^bearer_token$", r"^auth_token$", r"^client_secret.*\.json$", r"^oauth2.*\.json$",
    r"^\.password$", r"^password\.txt$", r"^passwords\.txt$", r"^\.secret$", r"^secret\.txt$", r"^secrets\.txt$", r"^apikey\.txt$", r"^api_key\.txt$", r"^api-key\.txt$", r"^\.git-credentials$", r"^git-credentials$",
    r"^\.htpasswd$", r"^auth\.json$", r"^\.ftpconfig$", r"^ftpconfig\.json$", r"^_netrc$", r"^\.bash_history$", r"^\.zsh_history$", r"^\.sh_history$", r"^\.history$", r"^\.mysql_history$", r"^\.psql_history$", r"^\.sqlite_history$",
    r"^\.pip/pip\.conf$", r"^credentials\.xml$", r"^secrets/.*\.xml$", r"^shadow$", r"^shadow\.bak$", r"^gshadow$", r"^\.muttrc$", r"^\.mailrc$", r"^\.ircrc$", r"^\.s3cfg$", r"^s3cfg$", r"^\.slack-token$", r"^slack[-_]token$",
    r"^\.github[-_]token$", r"^github[-_]token$", r"^\.netrc\.heroku$", r"^\.circleci/local[-_]config\.yml$", r"^vault[-_]pass.*\.txt$", r"^\.vault[-_]pass.*$", r"^\.npm[-_]token$", r"^settings\.xml$", r"^\.m2/settings\.xml$",
    r"^gradle\.properties$", r"^\.gradle/gradle\.properties$", r"^\.subversion/auth/.*$", r"^Login Data$", r"^Cookies$", r"/Login Data$", r"/Cookies$", r"/logins\.json$", r"/key[34]\.db$",
    r"\.mozilla/firefox/.*/logins\.json$", r"\.mozilla/firefox/.*/key[34]\.db$", r"\.config/chromium/.*/Login Data$", r"\.config/google-chrome/.*/Login Data$", r"\.kdbx$", r"\.kdb$", r"^1Password\.sqlite$", r"^1Password.*\.sqlite$",
    r"\.agilekeychain/", r"\.opvault/", r"^password-store$", r"^passwords\.kdbx$", r"^keepass\.kdbx$", r"^wallet\.dat$", r"^default_wallet$", r"^\.bitcoin/wallet\.dat$", r"^\.ethereum/keystore/.*$", r"^\.electrum/wallets/.*$", r"/keystore/UTC--.*$",
    r"^dump\.rdb$", r"^mongodb\.dump$", r"\.bson$", r"\.dump$", r"^\.idea/dataSources\.xml$", r"^\.idea/webServers\.xml$", r"^\.idea/deployment\.xml$", r"^\.vagrant/machines/.*/private_key$", r"^\.vagrant\.d/insecure_private_key$",
    r"^cookies\.txt$", r"^\.cookies$", r"^session$", r"^sessionid$", r"^\.wget-hsts$", r"^core$", r"^core\.\d+$", r"\.core$", r"\.dmp$", r"\.mdmp$", r"^Credentials$", r"^NTUSER\.DAT$", r"^SAM$", r"\.keychain$", r"\.keychain-db$", r"\.csr$",
    r"^oauth[-_]token.*$", r"^bearer[-_]token.*$", r"^jwt[-_]token.*$", r"^\.token\..*$", r"^api[-_]keys?\..*$", r"^\.redis_history$", r"^\.mongo_history$", r"^\.dbshell$", r"^docker-compose\.override\.yml$", r"^docker-compose\..*\.yml$",
    r"^\.gcp[-_]credentials\.json$", r"^\.azure[-_]credentials$", r"^\.do[-_]token$", r"^\.linode[-_]token$", r"^\.msmtprc$", r"^\.fetchmailrc$", r"^wireguard\.conf$", r"^wg[0-9]+\.conf$", r"\.ovpn$",
    r"^PASSWORDS\.md$", r"^SECRETS\.md$", r"^CREDENTIALS\.md$", r"^ACCESS\.md$", r"\.asc$", r"\.gpg$", r"^\.ssh/config$", r"\.rdp$", r"^credentials\.db$", r"^credentials\.sqlite$", r"\.postman_environment\.json$",
    r"^\.ruby-env$", r"^\.rbenv-vars$", r"^\.python-env$", r"^\.node-env$", r"^\.rsync[-_]password$", r"^rsync[-_]password$",
)
# Folders, names and endings of files that are of no interest.
DULL_FOLDERS = (
    ".github .git .vscode .devcontainer .config .cargo .changeset .husky .aspect .eslint-plugin-local .yarn .gemini .ng-dev .configurations .tx dist build out output target release "
    "node_modules vendor third_party tmp temp cache .cache .tmp .pytest_cache .tox .venv .mypy_cache .next .svelte-kit .turbo .angular .dart_tool __pycache__ .ruff_cache .nox htmlcov cover "
    ".gradle .m2 .sbt .bloop .metals .bsp bin obj TestResults BenchmarkDotNet.Artifacts .vendor-new Godeps composer.phar .phpunit.result.cache .bundle .byebug_history .rspec_status .mvn .aws .gcp "
    "fastlane DerivedData xcuserdata local.properties .navigation captures .externalNativeBuild .cxx .idea .idea_modules .vs .history coverage .nyc_output logs log .DS_Store"
).split()
DULL_NAMES = (
    "package-lock.json .secrets .secret secrets.json secrets.yaml secrets.yml credentials.json credentials.yaml credentials.yml auth.json auth.yaml auth.yml api-keys.json api_keys.json service-account.json "
    "service_account.json private-key.pem private_key.pem id_rsa id_dsa id_ecdsa id_ed25519 keyfile keyfile.json gcloud-service-key.json firebase-adminsdk.json google-services.json GoogleService-Info.plist "
    ".DS_Store Thumbs.db db.sqlite3 db.sqlite3-journal .eslintcache .stylelintcache .node_repl_history .yarn-integrity celerybeat-schedule celerybeat.pid ThirdPartyNoticeText.txt ThirdPartyNotices.txt cglicenses.json cgmanifest.json"
).split()
DULL_ENDINGS = (
    ".lock .log .tmp .temp .cache .bak .backup .orig .swp .swo .rej .pid .seed .old .save .temporary .exe .dll .so .dylib .a .lib .o .obj .bin .class .pdb .dSYM .pyc .pyo .pyd .jar .war .ear .nar "
    ".db .sqlite .sqlite3 .mdb .accdb .zip .tar .gz .bz2 .xz .lz .lzma .Z .tgz .rar .7z .deb .rpm .pkg .dmg .msi .appx .snap .map .d.ts.map .min.js .min.css .key .pem .p12 .pfx .crt .cer .der .csr .jks "
    ".keystore .truststore .kate-swp .gnome-desktop .sublime-project .sublime-workspace .iml .iws .ipr .patch .diff .prof .profile .trace .perf .coverage .egg-info .egg .mo .pot .setup .paket.template"
).split()


def union(patterns: tuple[str, ...]) -> str:
    """One alternation; an end is the very end."""
    return "|".join(p.replace("$", r"\z") for p in patterns)


def without_name(path: Column) -> Column:
    return path.isNull() | (F.trim(path) == "")


def is_secret_path(path: Column) -> Column:
    """Whether any folder of a path holds secrets; paths without a name count as such.  Back slashes part folders, too."""
    return without_name(path) | F.replace(path, F.lit("\\"), F.lit("/")).rlike(union(SECRET_PATHS))


def is_secret_file(path: Column) -> Column:
    """Whether a file holds secrets, by its name or its whole path."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return without_name(path) | F.substring_index(plain, "/", -1).rlike(union(SECRET_FILES)) | plain.rlike(union(SECRET_FILES))


def endings(name: Column) -> Column:
    """All endings of a name that begin with a dot, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, F.size(parts)), ".")))


def is_dull(path: Column) -> Column:
    """Whether a file is of no interest: by an ending or the whole of its name, or any part of its path.  Lists are met as sets."""
    name = F.substring_index(path, "/", -1)
    of = lambda values: F.array(*map(F.lit, values))
    by_ending = F.contains(name, F.lit(".")) & F.arrays_overlap(endings(name), of(DULL_ENDINGS))
    return by_ending | name.isin(*DULL_NAMES) | F.arrays_overlap(F.split(path, "/"), of(DULL_FOLDERS))
