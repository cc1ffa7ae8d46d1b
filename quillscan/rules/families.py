"""Provider rules that follow one of two forms, built from their parameters.

A token is known by its own prefix. An assigned key has no such mark: it counts only as the value that is assigned to a
name in which the provider's occurs.
"""

from __future__ import annotations

import re
from itertools import product

CLASSES = {
    "hex": "0-9a-f", "HEX": "0-9A-F", "hexes": "0-9A-Fa-f", "digit": "0-9", "lower": "0-9a-z", "upper": "0-9A-Z", "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "word": "0-9A-Za-z_-",
    "words": "0-9A-Za-z_=.-", "base64": "0-9A-Za-z+/", "padded": "0-9A-Za-z+/=_-", "a-h": "0-9a-h", "bech32": "02-9AC-HJ-NP-Z",
}

# The formats that providers publish for their tokens.
#: Rule, prefix, class and length of what follows (a bound alone: at least), entropy.
TOKENS = """
1password-service-account-token ops_eyJ base64 250- 4
adobe-client-secret p8e- alnum 32 2
age-secret-key AGE-SECRET-KEY-1 bech32 58 0
alibaba-access-key-id LTAI alnum 20 2
anthropic-admin-api-key sk-ant-admin01- word 95 0
anthropic-api-key sk-ant-api03- word 95 0
artifactory-api-key AKCp alnum 69 4.5
artifactory-reference-token cmVmd alnum 59 4.5
aws-amazon-bedrock-api-key-long-lived ABSK base64 109-269 3
clickhouse-cloud-api-secret-key 4b1d alnum 38 3
clojars-api-token CLOJARS_ lower 60 2
databricks-api-token dapi hex 32 3
digitalocean-access-token doo_v1_ hex 64 3
digitalocean-pat dop_v1_ hex 64 3
digitalocean-refresh-token dor_v1_ hex 64 0
doppler-api-token dp.pt. alnum 43 2
duffel-api-token duffel_(?:test|live)_ words 43 2
easypost-api-token EZAK alnum 54 2
easypost-test-api-token EZTK alnum 54 2
facebook-page-access-token EAA[CM] alnum 100- 4
flutterwave-encryption-key FLWSECK_TEST- a-h 12 2
flyio-access-token fo1_ word 43 4
frameio-api-token fio-u- words 64 0
gcp-api-key AIza word 35 4
github-app-token gh[su]_ alnum 36 3
github-fine-grained-pat github_pat_ word 82 3
github-oauth gho_ alnum 36 3
github-pat ghp_ alnum 36 3
github-refresh-token ghr_ alnum 36-76 3
gitlab-deploy-token gldt- word 20 3
gitlab-feature-flag-client-token glffct- word 20 3
gitlab-feed-token glft- word 20 3
gitlab-incoming-mail-token glimt- word 25 3
gitlab-kubernetes-agent-token glagent- word 50 3
gitlab-oauth-app-secret gloas- word 64 3
gitlab-pat glpat- word 20 3
gitlab-ptt glptt- hex 40 3
gitlab-rrt GR1348941 word 20 3
gitlab-runner-authentication-token glrt- word 20 3
gitlab-scim-token glsoat- word 20 3
gitlab-session-cookie _gitlab_session= lower 32 3
grafana-api-key eyJrIjoi alnum 70-400 3
grafana-cloud-api-token glc_ base64 32-400 3
heroku-api-key-v2 HRKU-AA word 58 4
huggingface-access-token hf_ alpha 34 2
huggingface-organization-api-token api_org_ alpha 34 2
infracost-api-token ico- alnum 32 3
intra42-client-secret s-s4t2(?:ud|af)- hex 64 3
linear-api-key lin_api_ alnum 40 2
notion-api-token ntn_ alnum 46 4
npm-access-token npm_ alnum 36 2
octopus-deploy-api-key API- upper 26 3
openrouter-token sk-or-v1- hex 64 3.5
openshift-user-token sha256~ word 43 3.5
perplexity-api-key pplx- alnum 48 4
planetscale-api-token pscale_tkn_ words 32-64 3
planetscale-oauth-token pscale_oauth_ words 32-64 3
planetscale-password pscale_pw_ words 32-64 3
prefect-api-token pnu_ alnum 36 2
pulumi-api-token pul- hex 40 2
pypi-upload-token pypi-AgEIcHlwaS5vcmc word 50-1000 3
readme-api-token rdme_ lower 70 2
rubygems-api-token rubygems_ hex 48 2
scalingo-api-token tk-us- word 48 2
sendgrid-api-token SG. words 66 2
sentry-user-token sntryu_ hex 64 3.5
settlemint-application-access-token sm_aat_ alnum 16 3
settlemint-personal-access-token sm_pat_ alnum 16 3
settlemint-service-access-token sm_sat_ alnum 16 3
shippo-api-token shippo_(?:live|test)_ hexes 40 2
shopify-access-token shpat_ hexes 32 2
shopify-custom-access-token shpca_ hexes 32 2
shopify-private-app-access-token shppa_ hexes 32 2
shopify-shared-secret shpss_ hexes 32 2
slack-legacy-workspace-token xox[ar]- alnum 8-48 2
square-access-token (?:EAAA|sq0atp-) word 22-60 2
stripe-access-token [rs]k_(?:test|live|prod)_ alnum 10-99 2
twilio-api-key SK hexes 32 3
vault-batch-token hvb. word 138-300 4
vault-service-token hvs. word 90-120 3.5
"""
#: Rule, names, prefix of the value (-: none), class, length, entropy.
ASSIGNED = """
adafruit-api-key adafruit - word 32 0
adobe-client-id adobe - hex 32 2
airtable-api-key airtable - lower 17 0
algolia-api-key algolia - lower 32 0
alibaba-secret-key alibaba - lower 30 2
asana-client-id asana - digit 16 0
asana-client-secret asana - lower 32 0
beamer-api-token beamer b_ padded 44 0
bitbucket-client-id bitbucket - lower 32 0
bitbucket-client-secret bitbucket - padded 64 0
bittrex-access-key bittrex - lower 32 0
cisco-meraki-api-key meraki - hex 40 3
cloudflare-api-key cloudflare - word 40 2
cloudflare-global-api-key cloudflare - hex 37 2
codecov-access-token codecov - lower 32 0
cohere-api-token cohere|co_api_key - alnum 40 4
coinbase-access-token coinbase - word 64 0
confluent-access-token confluent - lower 16 0
confluent-secret-key confluent - lower 64 0
contentful-delivery-api-token contentful - padded 43 0
datadog-access-token datadog - lower 40 0
discord-api-token discord - hex 64 0
discord-client-id discord - digit 18 2
discord-client-secret discord - padded 32 2
droneci-access-token droneci - lower 32 0
dropbox-api-token dropbox - lower 15 0
dropbox-short-lived-api-token dropbox sl. padded 135 0
etsy-access-token etsy - lower 24 3
facebook-secret facebook - hex 32 3
fastly-api-token fastly - padded 32 0
finicity-api-token finicity - hex 32 0
finicity-client-secret finicity - lower 20 0
finnhub-access-token finnhub - lower 20 0
flickr-access-token flickr - lower 32 0
freshbooks-access-token freshbooks - lower 64 0
gitter-access-token gitter - word 40 0
gocardless-api-token gocardless live_ padded 40 0
intercom-api-key intercom - padded 60 0
jfrog-api-key jfrog|artifactory|bintray|xray - lower 73 0
jfrog-identity-token jfrog|artifactory|bintray|xray - lower 64 0
kraken-access-token kraken - padded 80-90 0
kucoin-access-token kucoin - hex 24 0
launchdarkly-access-token launchdarkly - padded 40 0
linear-client-secret linear - hex 32 2
linkedin-client-id linkedin|linked_in|linked-in - lower 14 2
linkedin-client-secret linkedin|linked_in|linked-in - lower 16 2
lob-api-key lob (?:live|test)_ hex 35 0
lob-pub-api-key lob (?:live|test)_pub_ hex 31 0
looker-client-id looker - lower 20 0
looker-client-secret looker - lower 24 0
mailgun-private-api-token mailgun key- hex 32 0
mailgun-pub-key mailgun pubkey- hex 32 0
mattermost-access-token mattermost - lower 26 0
messagebird-api-token messagebird|message_bird|message-bird - lower 25 0
netlify-access-token netlify - padded 40-46 0
new-relic-browser-api-token newrelic|new_relic|new-relic NRJS- hex 19 0
new-relic-insert-key newrelic|new_relic|new-relic NRII- word 32 0
new-relic-user-api-id newrelic|new_relic|new-relic - lower 64 0
new-relic-user-api-key newrelic|new_relic|new-relic NRAK- lower 27 0
nytimes-access-token nytimes|new-york-times|newyorktimes - padded 32 0
okta-access-token okta 00 word 40 4
plaid-client-id plaid - lower 24 3.5
plaid-secret-key plaid - lower 30 3.5
privateai-api-token privateai|private_ai|private-ai - lower 32 3
rapidapi-access-token rapidapi - word 50 0
sendbird-access-token sendbird - hex 40 0
sentry-access-token sentry - hex 64 3
sonar-api-token sonar (?:sq[apu]_)? padded 40 0
sumologic-access-id sumo su alnum 12 3
sumologic-access-token sumo - lower 64 3
telegram-bot-api-token telegr [0-9]{5,16}:A word 34 0
travisci-access-token travis - lower 22 0
twitch-api-token twitch - lower 30 0
twitter-access-secret twitter - lower 45 0
twitter-api-key twitter - lower 25 0
twitter-api-secret twitter - lower 50 0
twitter-bearer-token twitter A{22} alnum 80-100 0
typeform-api-token typeform tfp_ words 59 0
yandex-api-key yandex AQVN word 35-38 0
yandex-aws-access-token yandex YC word 38 0
zendesk-secret-key zendesk - lower 40 0
"""
#: Rules whose assigned value is a UUID, and the names it is assigned to.
UUIDS = """
heroku-api-key heroku
hubspot-api-key hubspot
kucoin-secret-key kucoin
messagebird-client-id messagebird|message_bird|message-bird
sendbird-access-id sendbird
snyk-api-token snyk
squarespace-access-token squarespace
"""
_UUID = "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def _count(length: str) -> str:
    return "{" + length.replace("-", ",") + "}"


def _rule(name: str, regex: str, keywords: list[str], entropy: str) -> dict:
    return {"id": name, "description": f"What looks like a secret: {name.replace('-', ' ')}.", "regex": regex, "keywords": keywords, "entropy": float(entropy)}


def _literals(prefix: str) -> list[str]:
    """All texts of a prefix with groups and classes of a few alternatives, in lower case."""
    parts = [m.split("|") if m else list(c) if c else [x] for m, c, x in re.findall(r"\(\?:([^)]*)\)|\[([^\]]*)\]|([^\[(]+)", prefix)]
    return ["".join(x).lower() for x in product(*parts)]


def _escaped(prefix: str) -> str:
    return prefix if "(" in prefix or "[" in prefix or "{" in prefix else prefix.replace(".", r"\.")


def _assigned(name: str, names: str, value: str, entropy: str) -> dict:
    found = rf"(?i)(?:{names})[\w.-]{{0,40}}[\"']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}[\"']?({value})(?:[^0-9A-Za-z_-]|$)"
    return _rule(name, found, names.split("|"), entropy)


def rules() -> list[dict]:
    """The rules of all families, as tables of a rule file."""
    out = []
    for name, prefix, kind, length, entropy in map(str.split, TOKENS.strip().splitlines()):
        start = "" if prefix.startswith("_") else r"\b"
        out.append(_rule(name, rf"{start}({_escaped(prefix)}[{CLASSES[kind]}]{_count(length)})(?:[^0-9A-Za-z_-]|$)", _literals(prefix), entropy))
    for name, names, prefix, kind, length, entropy in map(str.split, ASSIGNED.strip().splitlines()):
        out.append(_assigned(name, names, f"{'' if prefix == '-' else _escaped(prefix)}[{CLASSES[kind]}]{_count(length)}", entropy))
    for name, names in map(str.split, UUIDS.strip().splitlines()):
        out.append(_assigned(name, names, _UUID, "0"))
    return out
