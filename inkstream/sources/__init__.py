"""Readers and writers: HTML trees and microformats, feeds, XML and JSON objects, tables, mail, contacts, outlines."""
