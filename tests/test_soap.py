"""SOAP layouts written by hand: interfaces in another package and module, overloads, headers and
bodies by binding style, bean definitions followed from their variable.  Expected rows by hand."""

import pytest

from srcframe.operators import soap
from srcframe.operators.facts import JavaFacts

SEI = '''package api;
@WebService(targetNamespace = "urn:%s", name = "P")
public interface Port {
    @WebMethod(operationName = "byId") String find(String id);
    @WebMethod(operationName = "byBoth", action = "go") @RequestWrapper(localName = "f", className = "api.F")
    String find(String id, int n);
    String plain(String id);
}
'''
IMPL = '''package impl;
import api.Port;
@Service
@WebService(endpointInterface = "Port", targetNamespace = "urn:own", portName = "pn", serviceName = "S")
public class Impl implements Port {
    public String find(String id) { return id; }
    public String find(String id, int n) { return id; }
    public String plain(String id) { return id; }
    @WebMethod(exclude = true) public String hidden(String id) { return id; }
}
'''
BARE = '''package b;
@WebService(endpointInterface = "gone.Nowhere", targetNamespace = "urn:b")
@SOAPBinding(style = SOAPBinding.Style.DOCUMENT, parameterStyle = SOAPBinding.ParameterStyle.BARE)
public class Bare {
    @WebMethod public Reply put(@WebParam(name = "auth", header = true) Token auth, Map<String, List<Order>> orders) { return null; }
    @WebMethod @WebResult(name = "t", header = true)
    public Trace del(@WebParam(header = true, name = "x", partName = "p") A a, @WebParam(name = "p", header = true) B p) { return null; }
    @WebMethod @SOAPBinding(parameterStyle = SOAPBinding.ParameterStyle.WRAPPED) @WebResult(header = true)
    public int ask(String q, int n) { return 1; }
}
'''
SPRING = '''package s;
@Endpoint
public class Pay {
    @PayloadRoot(namespace = "urn:pay", localPart = "PayRequest")
    public void pay(@RequestPayload Doc d, @SoapHeader("{urn:h}sig") Sig s, @SoapHeader Raw r) { }
    public void helper(int x) { }
}
'''
BEANS = '''package c;
@Configuration
public class Ws {
    @Bean(name = "x") public DefaultWsdl11Definition orders() {
        DefaultWsdl11Definition a = new DefaultWsdl11Definition();
        DefaultWsdl11Definition other = new DefaultWsdl11Definition();
        other.setTargetNamespace("urn:trap");
        a.setPortTypeName("first");
        a.setPortTypeName("OrdersPort");
        a.setLocationUri(BASE);
        DefaultWsdl11Definition b = a;
        b.setTargetNamespace("urn:orders");
        return b;
    }
    @Bean public org.x.DefaultWsdl11Definition bare() {
        DefaultWsdl11Definition d = new DefaultWsdl11Definition();
        d.setTargetNamespace("");
        d.setLocationUri("/bare");
        return d;
    }
    @Bean public Other no() { return null; }
    public DefaultWsdl11Definition unmarked() { return null; }
}
'''


@pytest.fixture(scope="module")
def fx(spark):
    rows = [("r", "m1/api/Port.java", SEI % "one"), ("r", "m2/api/Port.java", SEI % "two"),
            ("r", "m2/impl/Impl.java", IMPL), ("r", "m3/impl/Impl.java", IMPL), ("q", "m1/impl/Impl.java", IMPL),
            ("r", "b/Bare.java", BARE), ("r", "s/Pay.java", SPRING), ("r", "c/Ws.java", BEANS)]
    return JavaFacts(spark.createDataFrame(rows, "repo_id string, path string, content string"))


def test_overlay_picks_the_module_and_keeps_own_values(fx):
    got = {(r.repo_id, r.path): r for r in soap.sei_overlay(fx.classes).collect()}
    same, other, gone = got["r", "m2/impl/Impl.java"], got["r", "m3/impl/Impl.java"], got["q", "m1/impl/Impl.java"]
    assert (same.sei_path, same.target_namespace) == ("m2/api/Port.java", "urn:two")
    assert (other.sei_path, other.target_namespace) == ("m1/api/Port.java", "urn:one")
    assert (same.port_type_name, same.port_name, same.service_name) == ("P", "pn", "S")
    assert (gone.sei_fqn, gone.target_namespace, gone.port_type_name) == (None, "urn:own", None)
    bare = got["r", "b/Bare.java"]
    assert (bare.sei_fqn, bare.style, bare.parameter_style) == (None, "DOCUMENT", "BARE")
    assert got["r", "s/Pay.java"].is_ws is False and ("r", "c/Ws.java") not in got


def test_merge_by_name_and_arity(fx):
    m = soap.merged_methods(fx).where("path = 'm2/impl/Impl.java'").orderBy("ordinal").collect()
    assert [(r.method_name, r.arity, [a.split("(")[0] for a in r.merged]) for r in m] == [
        ("find", 1, ["@WebMethod"]), ("find", 2, ["@WebMethod", "@RequestWrapper"]), ("plain", 1, []),
        ("hidden", 1, ["@WebMethod"])]


def test_jaxws_rows(fx):
    got = {(r.file_path, r.operation_name): r for r in soap.jaxws_endpoints(fx).where("class_fqn = 'impl.Impl'").collect()}
    assert set(got) == {("m2/impl/Impl.java", "byId"), ("m2/impl/Impl.java", "byBoth"),
                        ("m3/impl/Impl.java", "byId"), ("m3/impl/Impl.java", "byBoth")}
    r = got["m2/impl/Impl.java", "byBoth"]
    assert (r.request_body_type, r.response_body_type, r.soap_action, r.path) == ("api.F", "String", "go", "S/byBoth")
    assert got["m3/impl/Impl.java", "byId"].request_body_type == "String"


def test_headers_and_bodies(fx):
    got = {(r.class_fqn, r.method_name): r for r in soap.soap_endpoints(fx).where("path not like 'S/%'").collect()}
    put, del_, ask, pay = (got[k] for k in (("b.Bare", "put"), ("b.Bare", "del"), ("b.Bare", "ask"), ("s.Pay", "pay")))
    assert (put.request_headers, put.request_body_type, put.response_body_type) == (
        {"auth": "Token"}, "Map<String, List<Order>>", "Reply")
    assert (del_.request_headers, del_.response_headers, del_.request_body_type, del_.response_body_type) == (
        {"p": "B"}, {"t": "Trace"}, "A", "Trace")
    assert (ask.parameter_style, ask.response_headers, ask.request_body_type, ask.response_body_type) == (
        "WRAPPED", {"return": "int"}, "askRequest", "askResponse")
    assert (pay.request_headers, pay.request_body_type, pay.response_body_type) == (
        {"sig": "Sig", "r": "Raw"}, "payRequest", None)
    assert (pay.operation_name, pay.target_namespace, pay.header_qnames) == ("PayRequest", "urn:pay", ["{urn:h}sig"])
    assert ("s.Pay", "helper") not in got


def test_excluded_and_implicit_methods(fx):
    got = [r.method_name for r in soap.soap_endpoints(fx).where("file_path = 'm2/impl/Impl.java'").collect()]
    assert sorted(got) == ["find", "plain"]


def test_bean_definitions(fx):
    got = {r.wsdl_key: r for r in soap.wsdl_bean_defs(fx).collect()}
    assert set(got) == {"urn:orders", "bare"}
    a, b = got["urn:orders"], got["bare"]
    assert (a.keyed_by, a.bean_name, a.port_type_name, a.location_uri) == ("namespace", "orders", "OrdersPort", None)
    assert (b.keyed_by, b.target_namespace, b.location_uri) == ("bean", None, "/bare")
