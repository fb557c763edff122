"""Scans of files and archives; tables of points, trees and chats."""
