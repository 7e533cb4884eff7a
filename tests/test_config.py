"""Settings."""

from dropscope.config import Config


def test_from_text():
    text = 'ENABLE_IPV6="false"\nTCP_SERVICES="80 443"\nBF_HITCOUNT="7"\nTCP_PASSIVE_RANGE="5000:5010"\n# X="1"\nBANNED_COUNTRIES="nl de"\nBAN_TIMEOUT="0"\n'
    c = Config.from_text(text)
    assert not c.ipv6 and c.tcp_services == (80, 443) and c.brute_hits == 7 and c.tcp_passive_range == (5000, 5010)
    assert c.banned_countries == ("nl", "de") and c.ban_timeout == 0 and c.udp_services == Config().udp_services


def test_toggled():
    c = Config().toggled("tcp_services", 80)
    assert c.tcp_services == (22, 443, 80) and c.toggled("tcp_services", 22).tcp_services == (443, 80)


def test_brute_ports_leave_out_the_bypass():
    assert Config(bypass_brute_tcp=(22,)).brute_ports("tcp") == (443,)
